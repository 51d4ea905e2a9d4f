"""Exact Jaccard self-join of word shingle sets by set-relation skipping.

Sets that are equal are one set.  An index over the prefix tokens of each set is cut into
blocks of a token and a size band, and entries carry their position, so that blocks and
entries which cannot reach the bound are skipped unread.  Each block first meets a few
leaders only.  A set that is linked with a leader takes over its answers: pairs inside one
component are never computed, and pairs whose distances to a common leader differ too much
are ruled out by the triangle inequality.  What remains is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

SHINGLE_WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles that many documents share come last in the order of tokens.  The order decides
#: the cost, never the result, so the list may be bounded: the most frequent ones.
HOT_IN_BATCH, HOT_TOTAL, HOT_TOKENS = 3, 48, 100_000
#: Entries of a frequent token that share one leader.
LEADER_ENTRIES = 500
#: Different orders of leaders: a set meets about so many members of its group.
LEADER_ORDERS = 8
#: Further turns in which sets meet members of the largest component around them.
COMPONENT_TURNS, TURN_ORDERS = 1, 61
#: Of consecutive size bands; a little over 100 / PERCENT, so that linked sets are at most one band apart.
BAND_RATIO = 1.26
CACHE_WORDS = 200_000
#: Rows of two numbers up to which a side is broadcast.
BROADCAST_IDS = 1_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    common.hold_cache("shingles", _words.clear)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    s = h[: n - size + 1] * _FACTORS[0]
    for k in range(1, size):
        s = s + (h[k : n - size + 1 + k] ^ (h[k : n - size + 1 + k] >> np.uint64(29 + k))) * _FACTORS[k % 5]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()) ^ len(shingles)).astype(np.int64)))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _documents(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _members(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, sid of every row; ``hot``: (token, count) pairs of one batch, at its first row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= HOT_IN_BATCH
        hot = np.stack([_signed(token[often]), count[often]], axis=1).tolist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([len(s) for s in sets], type=pa.int64()),
                pa.array([set_id(s) if len(s) else None for s in sets], type=pa.int64()),
                pa.array([hot, *[None] * (len(sets) - 1)], type=pa.list_(pa.list_(pa.int64()))),
            ],
            names=["doc_id", "text_key", "n", "sid", "hot"],
        )

    return common.map_batches(_documents(docs, F.xxhash64("text").alias("text_key")), run, "doc_id long, text_key long, n long, sid long, hot array<array<long>>")


def _hot_tokens(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, with their counts: at most HOT_TOKENS."""
    pairs = members.filter("hot is not null").select(F.explode("hot").alias("h"))
    top = pairs.groupBy(F.col("h")[0].alias("token")).agg(F.sum(F.col("h")[1]).alias("count")).filter(F.col("count") >= HOT_TOTAL)
    top = top.orderBy(F.desc("count"), "token").limit(HOT_TOKENS).toArrow()
    token, count = (np.asarray(top.column(i).to_numpy(), dtype=np.int64) for i in (0, 1))
    order = np.argsort(token.view(np.uint64))
    return token[order].view(np.uint64), count[order]


def _prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """Per distinct set: sid, n, rep (its smallest doc_id), prefix tokens in order, their salts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)  # at most HOT_TOKENS pairs of numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = shared.value
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(text, size)
            if not len(s) or doc_id is None:
                continue
            n, sid = len(s), set_id(s)
            k = prefix_length(n, percent)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                is_hot = known[at] == s
            if len(known) and is_hot.any():
                often = np.flatnonzero(is_hot)
                often = often[np.lexsort((s[often], counts[at[often]]))]
                order = np.concatenate([np.flatnonzero(~is_hot), often])[:k]
                parts = np.maximum(1, -(-counts[at[order]] // LEADER_ENTRIES))
                salts = np.where(is_hot[order], 1 + (sid & 0x7FFFFFFF) % parts, 0)
                tokens = s[order]
            else:
                tokens, salts = s[:k], np.zeros(k, dtype=np.int64)
            rows.append((doc_id, n, sid, _signed(tokens), salts))
        ends = pa.array(np.cumsum([0, *[len(r[3]) for r in rows]]), type=pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *[r[i] for r in rows]]), type=pa.int64())) for i in (3, 4)]
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], type=pa.int64()) for i in range(3)), *lists], names=["doc_id", "n", "sid", "tokens", "salts"])

    rows = common.map_batches(_documents(docs), run, "doc_id long, n long, sid long, tokens array<long>, salts array<long>")
    return rows.groupBy("sid").agg(F.first("n").alias("n"), F.first(F.struct("tokens", "salts")).alias("p")).select("sid", "n", "p.tokens", "p.salts")


def _needed_overlap(n1, n2, percent: int):
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent) - F.lit(1e-9))


def _can_link(x: str, y: str, percent: int):
    """Size and position bounds for two entries of one list; both are necessary for a link."""
    nx, ny, px, py = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    most = F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (most >= _needed_overlap(nx, ny, percent))


def _least_shared(percent: int):
    """Prefix tokens that linked sets of _na and _nb tokens surely share; see _screened."""
    overlap = _needed_overlap(F.col("_na"), F.col("_nb"), percent)
    need = lambda n: overlap - F.ceil(percent * n / F.lit(100) - F.lit(1e-9)) + 1
    return F.least(need(F.col("_na")), need(F.col("_nb")))


def _first_shared(least):
    """How many of the shared prefix tokens are looked for at first."""
    return F.ceil(least / 2)


def _early(x: str, y: str, percent: int):
    """Position bound of the first shared tokens.

    Before the k-th token that two sets share, each has at most n - overlap tokens of its own
    and k - 1 shared ones.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    overlap = _needed_overlap(nx, ny, percent)
    need = lambda n: overlap - F.ceil(percent * n / F.lit(100) - F.lit(1e-9)) + 1
    k = _first_shared(F.least(need(nx), need(ny)))
    return (F.col(f"{x}pos") <= nx - overlap + k - 1) & (F.col(f"{y}pos") <= ny - overlap + k - 1)


def _screened(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough tokens.

    A set misses at most n - o tokens of a partner with overlap o, so of its k prefix tokens at
    least k - (n - o) are common.  The set whose prefix ends first in the order of tokens finds
    all of those in the other's prefix; which one it is need not be known for the smaller bound.
    """
    one = profiles.select(F.col("sid").alias("a"), F.col("tokens").alias("_ta"), F.col("n").alias("_na"))
    two = profiles.select(F.col("sid").alias("b"), F.col("tokens").alias("_tb"), F.col("n").alias("_nb"))
    shared = F.size(F.array_intersect("_ta", "_tb"))
    return pairs.join(one, "a").join(two, "b").filter(shared >= _least_shared(percent)).select("a", "b")


def _sets(docs: DataFrame, rep: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The whole token sets of the paired sets, each from the text of its smallest doc_id."""
    sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = common.cut(sids.join(rep, "sid").select("doc_id", F.col("sid").alias("_sid")), "wanted")
    # Checked: so many pairs of numbers fit any executor; more are joined by shuffle.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        rows = [(k, _signed(s).tolist()) for s, k in zip(sets, batch.column(0).to_pylist(), strict=True) if len(s) and set_id(s) == k]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.list_(pa.int64()))], names=["sid", "tokens"])

    fetched = _documents(docs).join(side, "doc_id").select("_sid", "text")
    return common.cut(common.map_batches(fetched, tokens, "sid long, tokens array<long>").dropDuplicates(["sid"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact answer of each pair: a, b, distance (1 - Jaccard), linked."""
    one = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("_ta"))
    two = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("_ta", "_tb")).cast("long")
    return both.select("a", "b", F.size("_ta").alias("na"), F.size("_tb").alias("nb"), inter.alias("i")).select(
        "a", "b", (1 - F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("distance"), (100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).alias("linked")
    )


def _mixed_entries(index: DataFrame, labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Entries of lists that hold several components (c), each with its nearest leader (l, d)."""
    told = answers.select(F.col("a").alias("sid"), F.col("b").alias("l"), "distance").unionByName(answers.select(F.col("b").alias("sid"), F.col("a").alias("l"), "distance"))
    told = told.groupBy("sid").agg(F.min(F.struct("distance", "l")).alias("m")).select("sid", F.col("m.l").alias("l"), F.col("m.distance").alias("d"))
    state = index.select("sid").distinct().join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").join(told, "sid", "left")
    state = common.cut(state.select("sid", F.coalesce("label", "sid").alias("c"), "l", "d"), "state")
    marked = index.select("token", "sid", "n", "pos", "band").join(state, "sid")
    mixed = common.cut(marked.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("token"), "mixed")
    return common.cut(marked.join(mixed, "token"), "marked")


def size_class(n: int) -> int:
    """Sizes up to 127 are classes of their own, larger ones share their first seven bits."""
    k = max(0, n.bit_length() - 7)
    return k * 64 + (n >> k)


def _class_of(n: str):
    k = f"greatest(length(bin({n})) - 7, 0)"
    return F.expr(f"{k} * 64 + shiftright({n}, {k})")


@lru_cache(maxsize=20_000)
def _bounds(n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per size class of a partner that is not smaller: the class, the last position that counts, the least number of entries up to it."""
    kept = lambda x: -(-percent * x // 100)
    overlap = lambda x: -(-percent * (n + x) // (100 + percent))
    out = []
    for aim in range(size_class(n), size_class(n * 100 // percent) + 1):
        k = max(0, aim // 64 - 1)
        low, high = max(n, aim - 64 * k << k), min((aim - 64 * k + 1 << k) - 1, n * 100 // percent)
        # Tokens that both surely share is the smaller of what either prefix tells (see _least_shared):
        # own's grows with the partner, the partner's falls but for rounding.
        most = min(overlap(high) - kept(n) + 1, overlap(low) - kept(low) + 2)
        least = min(overlap(low) - kept(n) + 1, overlap(high) - kept(high))
        out.append((aim, n - overlap(low) - (-most // 2) - 1, max(1, -(-least // 2))))
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True))


def _prospects(marked: DataFrame, percent: int) -> DataFrame:
    """Entries of each set by the size class of a larger partner they may help to find: token, aim, sid, n, pos, c, l, d.

    A set links with one of a class only if the two share at least k of their first prefix
    tokens, so a set with fewer entries than that, among those lists that hold other components
    at all, has no partner there.  It is dropped before any pair is made, however many sets
    share its frequent tokens.  Bounds hold for the whole class.
    """
    common.small_batches(marked.sparkSession)
    own = marked.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "c", "l", "d")], F.collect_list("pos").alias("pos"), F.collect_list("token").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_pylist()
            lengths = pc.list_value_length(batch.column(5)).to_numpy()
            pos, tokens = (batch.column(k).flatten().to_numpy() for k in (5, 6))
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((pos, row))
            pos, tokens = pos[order].astype(np.int64), tokens[order]
            starts = np.cumsum(lengths) - lengths
            aims, lasts, leasts = (np.concatenate(x) for x in zip(*[_bounds(n, percent) for n in sizes], strict=True))
            owner = np.repeat(np.arange(len(sizes)), [len(_bounds(n, percent)[0]) for n in sizes])
            count = np.searchsorted(row * 2**32 + pos, owner * 2**32 + lasts, side="right") - starts[owner]
            able = np.flatnonzero(count >= leasts)
            count, owner, aims = count[able], owner[able], aims[able]
            at = np.repeat(starts[owner], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows = pa.array(np.repeat(owner, count))
            columns = [pa.array(tokens[at]), pa.array(pos[at].astype(np.int32)), pa.array(np.repeat(aims, count).astype(np.int32)), *(batch.column(k).take(rows) for k in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "pos", "aim", "sid", "n", "c", "l", "d"])

    return own.mapInArrow(run, "token long, pos int, aim int, sid long, n int, c long, l long, d double")


def _meetings(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of their first prefix tokens."""
    entries = common.cut(_prospects(marked, percent), "prospects")
    side = lambda rows, p: rows.select("token", *[F.col(c).alias(p + c) for c in rows.columns if c != "token"])
    x = side(entries, "x")
    y = side(marked.select("token", "sid", "n", "pos", "c", "l", "d", _class_of("n").alias("class")), "y").withColumnRenamed("token", "_token")
    # Linked sets are no further apart than 1 - percent / 100, so neither are their distances to a third.
    ruled_out = (F.col("xl") == F.col("yl")) & (F.abs(F.col("xd") - F.col("yd")) > 1 - percent / 100 + 1e-9)
    larger = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xsid") < F.col("ysid")))
    able = larger & (F.col("xc") != F.col("yc")) & _can_link("x", "y", percent) & _early("x", "y", percent) & ~F.coalesce(ruled_out, F.lit(False))
    meet = x.join(y, (x["token"] == y["_token"]) & (x["xaim"] == y["yclass"]) & able)
    # The first shared tokens of a pair that can link are all rows here, so they can be counted at once.
    rest = meet.groupBy(*_ordered_pairs("xsid", "ysid")).agg(F.count("*").alias("shared"), F.first("xn").alias("_na"), F.first("yn").alias("_nb"))
    return rest.filter(F.col("shared") >= _first_shared(_least_shared(percent))).select("a", "b")


def _ordered_pairs(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_components(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space after lower-casing A-Z; a set
    holds the distinct ``size``-word shingles, or the whole word sequence if it is shorter.
    Sets link when 100 * intersection >= ``percent`` * union; component_id is the smallest
    doc_id reachable.  Null, empty and wordless texts have no shingle and link with nothing.
    Repeated rows give repeated results with one component.  A row without doc_id gets no
    component and takes no part.  Shingles are compared by 64-bit hashes.  Columns besides
    doc_id and text are not read; an empty table gives no rows.
    """
    return _linked(docs, size, percent).drop("text_key")


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """link_components, and text_key: a hash of the row's text."""
    members = common.cut(_members(docs, size), "members")
    prefixes = _prefixes(docs, _hot_tokens(members), size, percent)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND_RATIO))).cast("int")
    entries = prefixes.select("sid", F.col("n").cast("int").alias("n"), F.posexplode(F.arrays_zip("tokens", "salts")).alias("pos", "t"))
    entries = entries.select(F.col("t.tokens").alias("token"), F.col("t.salts").cast("int").alias("salt"), "sid", "n", "pos", band.alias("band"))
    # Lists of one entry go; the leader of a block is the first by one of a few hash orders.
    rank = F.xxhash64("sid", F.pmod("token", F.lit(LEADER_ORDERS)))
    block = Window.partitionBy("token", "salt", "band")
    listed = entries.repartition("token", "salt").withColumn("entries", F.count("*").over(Window.partitionBy("token", "salt")))
    # A salted list holds many entries; its single ones may still meet other salts.
    listed = listed.filter("entries > 1 or salt > 0").withColumn("leader", F.min(F.struct(rank.alias("rank"), "sid", "n", "pos")).over(block))
    index = common.cut(listed.select("token", "salt", "sid", "n", "pos", "band", F.col("leader.sid").alias("leader"), F.col("leader.n").alias("ln"), F.col("leader.pos").alias("lpos")), "index")
    star = index.filter("sid <> leader").select("token", F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), F.col("leader").alias("y"), F.col("ln").alias("yn"), F.col("lpos").alias("ypos"))
    # The leaders of the salted parts of a block meet their own leader.
    heads = index.filter("sid = leader").select("token", "band", "salt", "sid", "n", "pos", rank.alias("rank"))
    head = heads.groupBy("token", "band").agg(F.min(F.struct("rank", "sid", "n", "pos")).alias("h"), F.count("*").alias("c")).filter("c > 1")
    heads = heads.join(head, ["token", "band"]).filter("sid <> h.sid")
    star = star.unionByName(heads.select("token", F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), F.col("h.sid").alias("y"), F.col("h.n").alias("yn"), F.col("h.pos").alias("ypos")))
    # Of each set the prefix tokens that any other set has.
    profiles = common.cut(index.groupBy("sid").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")), "profiles")
    met = common.cut(star.filter(_can_link("x", "y", percent)).select(*_ordered_pairs("x", "y")).distinct(), "met")
    first = common.cut(_screened(met, profiles, percent), "pairs")
    rep = members.filter("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    answers = common.cut(_verified(first, _sets(docs, rep, first, size), percent), "answers")
    links = common.cut(answers.filter("linked").select("a", "b"), "links")
    labels = components(links)
    marked = index
    for turn in range(COMPONENT_TURNS):
        # Sets outside the largest component of a block meet other members of it.
        marked = _mixed_entries(marked, labels, answers)
        common.discard(index)  # its rows are in marked, and what every set has of it in the profiles
        fresh = F.xxhash64("sid", F.pmod("token", F.lit(TURN_ORDERS)), F.lit(turn))
        each = marked.groupBy("token", "band", "c").agg(F.count("*").alias("size"), F.min(F.struct(fresh.alias("rank"), "sid", "n", "pos")).alias("h"))
        most = each.groupBy("token", "band").agg(F.max(F.struct("size", "c", "h")).alias("m")).filter("m.size > 1")
        most = common.cut(most.select("token", "band", F.col("m.c").alias("hc"), F.col("m.h.sid").alias("y"), F.col("m.h.n").alias("yn"), F.col("m.h.pos").alias("ypos")), "heads")
        star = marked.join(most, ["token", "band"]).filter("c <> hc").select(F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), "y", "yn", "ypos")
        new = common.cut(star.filter(_can_link("x", "y", percent)).select(*_ordered_pairs("x", "y")).distinct().join(met, ["a", "b"], "left_anti"), "met")
        pairs = common.cut(_screened(new, profiles, percent), "pairs")
        told = common.cut(_verified(pairs, _sets(docs, rep, pairs, size), percent), "answers")
        met, answers = met.unionByName(new), answers.unionByName(told)
        more = told.filter("linked").select("a", "b")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)

    # What still holds several components is computed pair by pair.
    marked = _mixed_entries(marked, labels, answers)
    rest = _meetings(marked, percent).join(met, ["a", "b"], "left_anti")
    rest = _screened(rest, profiles, percent)
    rest = common.cut(rest, "pairs")
    more = common.cut(_verified(rest, _sets(docs, rep, rest, size), percent).filter("linked").select("a", "b"), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    owner = members.filter("doc_id is not null and sid is not null").join(labels.select(F.col("node").alias("sid"), "label"), "sid")
    least = owner.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = labels.select(F.col("node").alias("sid"), "label").join(least, "label").select("sid", F.col("component_id").alias("joined"))
    # Sets without a link: their copies alone.
    alone = rep.join(by_set, "sid", "left").select("sid", F.coalesce("joined", "doc_id").alias("component"))
    return (
        members.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "sid")
        .join(alone, "sid", "left")
        .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Columns and all other rows stay.  Of rows that share a doc_id each is judged by its own
    text, so one goes only if its own text is a copy; those whose doc_id is the component's stay.
    """
    linked = _linked(docs, size, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("__qw_id"), F.col("text_key").alias("__qw_key")).distinct()
    keyed = docs.withColumn("__qw_text_key", F.xxhash64("text"))
    return keyed.join(linked, (F.col("doc_id").cast("long") == F.col("__qw_id")) & (F.col("__qw_text_key") == F.col("__qw_key")), "left_anti").drop("__qw_text_key")
