"""How far the term use of each source of a language lies from that of every other source.

Term counts of a (lang, source) group are cut into chunks of terms and compressed into vectors.
The groups of a language are dealt out to blocks that stay in their partitions, and the
compressed vectors of the other blocks travel: in each round of a round-robin tournament every
block meets one other, and a meeting evaluates both directions of all its pairs.  The vector of
the whole language makes one more round, in which a heap in each block ranks its terms.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Counts that a task holds before it writes them out.
HELD_COUNTS = 200_000
#: Rows (source, term) that share a chunk of a language's terms.
CHUNK_ROWS = 100_000
#: Groups of a block, until a language has MOST_BLOCKS of them.
BLOCK_GROUPS = 6
MOST_BLOCKS = 64
#: Rounds whose vectors are under way in the same job.
ROUNDS_AT_ONCE = 8
#: Languages up to which their totals are broadcast.
BROADCAST_LANGUAGES = 10_000
SCALE = 1_000_000_000
MOST_TERMS = 200
MIN_DOCUMENTS = 3

#: Bytes of terms: A-Z lowered, other ASCII but letters a space, the bytes of all else as they are.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Per lang, source, term: n occurrences and in how many documents (rows), partly summed.

    A task sums before anything is shuffled, so a hot source or term gives a row a task.
    """
    common.small_batches(docs.sparkSession)
    names = ("lang", "source", "term", "n", "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in held.items():
                terms = [t.decode("utf-8") for t in n]
                columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(terms, type=pa.string()), pa.array(n.values(), type=pa.int64()), pa.array(map(documents.__getitem__, n), type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if terms := text.encode("utf-8").translate(TERM_BYTES).split():
                    n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(terms)
                    documents.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD_COUNTS:
                yield from flush()
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, documents long")


# -- vectors --------------------------------------------------------------------------------------


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: steps between places, then counts, compressed."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, dtype="<u4", count=n).astype(np.int64)), np.frombuffer(raw, dtype="<i8", offset=4 * n)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), exactly: a division in two steps of SCALE's factors."""
    first, rest = np.divmod((counts + 1) * 100_000, whole)
    return 1 + first * 10_000 + rest * 10_000 // whole


def dense(row: dict) -> np.ndarray:
    """The shares of all ``size`` terms of a chunk in a group."""
    whole, size = row["total"] + row["kept"], row["size"]
    out = np.empty(size, dtype=np.int64)
    if size:
        out[:] = shares(np.zeros(1, dtype=np.int64), whole)[0]
        places, counts = unpack(row["body"])
        out[places] = shares(counts, whole)
    return out


def both_ways(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Sums of floor((p-q)^2/q) and of floor((q-p)^2/p); every square stays below 2**63."""
    square = (p - q).astype(np.int64) ** 2
    return int((square // q).sum()), int((square // p).sum())


VECTOR = "lang string, chunk int, block int, blocks int, source string, total long, kept long, size int, body binary, terms binary"


def chunk_vectors(table: pa.Table) -> pa.Table:
    """The vectors of all groups of one chunk of a language, and that of the language.

    Rows without a term stand for the groups themselves; every group has one.
    """
    rows = table.to_pydict()
    lang, chunk = rows["lang"][0], rows["chunk"][0]
    terms = sorted({t.encode("utf-8") for t in rows["term"] if t is not None})
    place = {t.decode("utf-8"): i for i, t in enumerate(terms)}
    counts: dict[str, dict[int, int]] = {}
    groups = []
    for k, (t, source) in enumerate(zip(rows["term"], rows["source"], strict=True)):
        if t is None:
            groups.append(k)
        else:
            counts.setdefault(source, {})[place[t]] = rows["n"][k]
    out = []
    whole = np.zeros(len(terms), dtype=np.int64)
    for k in groups:
        own = counts.get(rows["source"][k], {})
        places = np.array(sorted(own), dtype=np.int64)
        values = np.array([own[i] for i in places.tolist()], dtype=np.int64)
        whole[places] += values
        out.append({c: rows[c][k] for c in ("block", "blocks", "source", "total", "kept")} | {"body": pack(places, values), "terms": None})
    k = groups[0]
    out.append({"block": -1, "blocks": rows["blocks"][k], "source": None, "total": rows["lang_total"][k], "kept": rows["kept"][k], "body": pack(np.arange(len(terms)), whole), "terms": zlib.compress(b"\n".join(terms), 1)})
    return pa.Table.from_pylist([{"lang": lang, "chunk": chunk, "size": len(terms)} | r for r in out], schema=VECTOR_ARROW)


VECTOR_ARROW = pa.schema(
    [("lang", pa.string()), ("chunk", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("source", pa.string()), ("total", pa.int64()), ("kept", pa.int64()), ("size", pa.int32()), ("body", pa.binary()), ("terms", pa.binary())]
)
MEETING = "lang string, source string, part string, item string, value long"
MEETING_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def records(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, MEETING_ARROW, strict=True)], schema=MEETING_ARROW)


def meet(residents: pa.Table, travellers: pa.Table) -> pa.Table:
    """Both directions of every pair of a resident and a traveller; one dense traveller at a time."""
    found = []
    if residents.num_rows and travellers.num_rows:
        here = [(r["source"], dense(r)) for r in residents.to_pylist()]
        lang = residents["lang"][0].as_py()
        for t in travellers.to_pylist():
            q, other = dense(t), t["source"]
            for source, p in here:
                to, back = both_ways(p, q)
                found += [(lang, source, "pair", other, to), (lang, other, "pair", source, back)]
    return records(found)


def meet_own(residents: pa.Table, language: pa.Table, most: int = MOST_TERMS) -> pa.Table:
    """The pairs within a block, and each resident's leading terms against the language."""
    found = []
    if residents.num_rows:
        rows = residents.to_pylist()
        lang, here = rows[0]["lang"], [dense(r) for r in rows]
        for i, p in enumerate(here):
            for j in range(i + 1, len(here)):
                to, back = both_ways(p, here[j])
                found += [(lang, rows[i]["source"], "pair", rows[j]["source"], to), (lang, rows[j]["source"], "pair", rows[i]["source"], back)]
        whole = language.to_pylist()[0]
        q = dense(whole)
        terms = zlib.decompress(whole["terms"]).decode("utf-8").split("\n")
        for row, p in zip(rows, here, strict=True):
            places, _ = unpack(row["body"])
            places = places[p[places] > q[places]]
            values = (p[places] - q[places]) ** 2 // q[places]
            # Places follow the UTF-8 order of terms.
            leading = heapq.nsmallest(most, zip((-values).tolist(), places.tolist(), strict=True))
            found += [(lang, row["source"], "term", terms[i], -v) for v, i in leading]
    return records(found)


# -- rotation -------------------------------------------------------------------------------------


def mate(block, blocks, turn: int):
    """The block that ``block`` meets in a turn of the tournament (itself or none: it rests).

    One block of an even number stays in its place and the others walk around a circle.
    """
    ring = blocks + blocks % 2 - 1
    opposite = F.pmod(F.lit(2 * turn) - block, ring)
    met = F.when(block == ring, F.lit(turn)).when(opposite == block, ring).otherwise(opposite)
    return F.when((F.lit(turn) < ring) & (met < blocks), met)


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """Per lang, source: each other source of the lang (part ``pair``) and the group's leading
    terms against the lang (part ``term``, at most ``most_terms``): item, value, rank.

    Terms are runs of letters, A-Z lowered and any sign beyond ASCII a letter; a lang keeps those
    of ``min_documents`` rows at least.  A group's share of a term is p = 1 + floor(10**9 (n+1) /
    (N+V)) and a value is the sum of floor((p-q)**2/q).  Nulls are empty strings and empty texts
    have no terms; a group without terms is compared too; a lang with one source has no pair;
    each row is a document, also a repeated one; ties rank by the item's bytes; other columns are
    not read; an empty table gives no rows.  Sums of counts below 9 * 10**13 are exact.
    """
    spark = docs.sparkSession
    key = Window.partitionBy("lang", "term")
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = counts.withColumn("rows", F.sum("documents").over(key)).filter(F.col("rows") >= min_documents)
    kept = common.cut(kept.select("lang", "source", "term", "n", (F.row_number().over(key.orderBy("source")) == 1).alias("first")), "terms")

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("first").cast("int")).alias("kept"))
    groups = named.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "rows", "kept"])
    of_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang",
        "source",
        "total",
        F.sum("total").over(of_lang).alias("lang_total"),
        F.sum("kept").over(of_lang).alias("kept"),
        F.greatest(F.lit(1), F.ceil(F.sum("rows").over(of_lang) / CHUNK_ROWS)).cast("int").alias("chunks"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.count("*").over(of_lang) / BLOCK_GROUPS)).cast("int").alias("blocks"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"),
    )
    groups = common.cut(groups.withColumn("block", F.pmod(F.col("place"), F.col("blocks"))), "groups")

    langs = groups.select("lang", "chunks").distinct()
    n_langs, turns = groups.agg(F.count_distinct("lang"), F.coalesce(F.max(F.col("blocks") + F.col("blocks") % 2 - 1), F.lit(0))).first()
    langs = F.broadcast(langs) if n_langs <= BROADCAST_LANGUAGES else langs
    marks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    marks = marks.select("lang", "chunk", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "block", "blocks", "total", "lang_total", "kept")
    cells = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "source", "term", "n")
    vectors = common.cut(marks.unionByName(cells, allowMissingColumns=True).groupBy("lang", "chunk").applyInArrow(chunk_vectors, VECTOR), "vectors")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups_only, language = vectors.filter("source is not null").drop("terms"), vectors.filter("source is null")
    residents = groups_only.repartition(parts, "lang", "chunk", "block").persist(StorageLevel.MEMORY_AND_DISK)
    seats = residents.groupBy("lang", "chunk", "block")

    def own(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet_own(a, b, most_terms)

    everywhere = language.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meetings = [seats.cogroup(everywhere.groupBy("lang", "chunk", "block")).applyInArrow(own, MEETING)]
    written = []
    for turn in range(turns):
        home = mate(F.col("block"), F.col("blocks"), turn)
        guests = groups_only.withColumn("home", home).filter("home < block").withColumn("block", F.col("home")).drop("home")
        meetings.append(seats.cogroup(guests.groupBy("lang", "chunk", "block")).applyInArrow(meet, MEETING))
        if len(meetings) > ROUNDS_AT_ONCE or turn == turns - 1:
            written.append(_sum_up(meetings))
            meetings = []
    if meetings:
        written.append(_sum_up(meetings))
    residents.unpersist()
    common.discard(kept, groups, vectors)

    found = written[0]
    for more in written[1:]:
        found = found.unionByName(more)
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(terms)


def _sum_up(meetings: list[DataFrame]) -> DataFrame:
    """What some rounds found, written once; pairs of a lang's chunks are summed as they are read."""
    found = meetings[0]
    for more in meetings[1:]:
        found = found.unionByName(more)
    return common.cut(found, "meetings")
