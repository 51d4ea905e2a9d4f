"""Exact removal of long repeated byte strings by distributed difference-cover suffix sorting.

Equal windows of ``length`` bytes have equal minimisers, so texts are cut into stretches of
windows with one minimiser and only stretches that meet another with the same minimiser are
sorted.  They are dealt out by minimiser into shards of bounded size; each shard is sorted by
the difference-cover algorithm, and adjacent suffixes are compared over ``length`` bytes.
Equal stretches are counted first and sorted once.  Where very many different stretches share
a minimiser they are split by their offset to it and by the bytes that all windows of a piece
share, which keeps equal windows together and every shard small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from . import common
from .suffix_array import suffix_array

LENGTH = 400
#: Bytes hashed to choose a minimiser.
GRAM = 32
#: Different stretches of one minimiser beyond which they are split, and windows of a piece.
CROWDED, PIECE_WINDOWS = 256, 8
#: Bytes of a shard to aim at.
SHARD_BYTES = 1_000_000
#: Windows looked at together: positions must fit beside the hash in 64 bits.
POSITION_BITS = 22

_TABLE = np.frombuffer(b"".join(hashlib.sha256(b"byte %d" % i).digest()[:8] for i in range(256)), dtype="<u8")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h, factor, width = _TABLE[data], _FACTOR, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, width * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def sliding_minimum(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(a)
    blocks = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, dtype=a.dtype)
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def stretches(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows, minimiser hashes, offsets of the minimiser from the start."""
    n = len(raw)
    empty = np.zeros(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty
    data = np.frombuffer(raw, dtype=np.uint8)
    grams = length - GRAM + 1
    step = (1 << POSITION_BITS) - grams
    low = np.uint64((1 << POSITION_BITS) - 1)
    parts = []
    for at in range(0, n - length + 1, step):  # one pass but for texts of millions of bytes
        h = gram_hashes(data[at : at + step + length - 1])
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_minimum(key, grams) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        parts.append((first + at, np.diff(np.r_[first, len(place)]), h[place[first]].view(np.int64), place[first] - first))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def repeated_windows(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per text of a shard the runs (first, last) of windows that start elsewhere too.

    A text that occurs more than once has all its windows repeated.  The texts are joined by a
    symbol below every byte, so no window that crosses a border equals one that does not.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    joined[starts + sizes] = 0
    total = len(joined)
    room = np.repeat(starts + sizes, sizes + 1) - np.arange(total)
    order = suffix_array(joined)
    order = order[room[order] >= length]
    same = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        # Adjacent windows, eight bytes at a time; a pair that differs is not looked at again.
        packed = np.zeros(total + 8, dtype=np.uint64)
        bytes_ = np.concatenate([np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in range(8):
            packed[:total] |= bytes_[k : total + k] << np.uint64(8 * k)
        pair = np.arange(len(order) - 1)
        for k in [*range(0, length - 7, 8), length - 8]:
            pair = pair[packed[order[pair] + k] == packed[order[pair + 1] + k]]
        same[pair] = same[pair + 1] = True
    hit = np.zeros(total, dtype=bool)
    hit[order[same]] = True
    for s, n, c in zip(starts.tolist(), sizes.tolist(), counts, strict=True):
        if c > 1:
            hit[s : s + n - length + 1] = True
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2] - 1
    owner = np.searchsorted(starts, first, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for o, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(), (last - starts[owner]).tolist(), strict=True):
        out[o].append((a, b))
    return out


def cut_out(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the ranges [a, b), how many went, and the number of maximal runs."""
    kept, at, runs, end = [], 0, 0, -1
    for a, b in sorted(ranges):
        runs += a > end
        if a > at:
            kept.append(raw[at:a])
        at, end = max(at, b), max(end, b)
    kept.append(raw[at:])
    rest = b"".join(kept)
    return rest, len(raw) - len(rest), runs


_RUNS = "array<struct<first:int,last:int>>"


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            start, windows, mini, offset = stretches(raw, length)
            if not len(start):
                continue
            spans = zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)
            out[0] += [doc] * len(start)
            out[1] += [key] * len(start)
            out[6] += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans]
            for k, x in enumerate((start, windows, mini, offset)):
                out[2 + k].append(x)
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in out[2:6]]
        digest = np.array(out[6], dtype=np.uint64).view(np.int64)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
        columns = [pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.int64()), *(pa.array(x.astype(k.to_pandas_dtype()), type=k) for x, k in zip(flat, kinds, strict=True)), pa.array(digest)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "windows", "mini", "offset", "digest"])

    return common.map_batches(docs, run, "doc_id long, text_key long, start int, windows int, mini long, offset int, digest long")


def _bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The stretches of ``wanted`` (doc_id, text_key, start, windows, offset, mini, digest, c, crowded) with
    their bytes as sorting units; crowded ones in pieces: mini, digest, base, c, key, unit, raw."""
    picked = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows", "offset", "mini", "digest", "c", "crowded")).alias("parts"))
    picked = common.cut(picked.select(F.col("doc_id").alias("__qw_id"), F.col("text_key").alias("__qw_key"), "parts"), "picked")
    joined = docs.join(picked, docs["doc_id"].eqNullSafe(picked["__qw_id"]) & (docs["text_key"] == picked["__qw_key"])).select("text", "parts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for p in parts:
                start, windows, offset, mini, digest = p["start"], p["windows"], p["offset"], p["mini"], p["digest"]
                if not p["crowded"]:
                    rows.append((mini, digest, 0, p["c"], mini, digest, raw[start : start + windows + length - 1]))
                    continue
                # Windows by the offset of the minimiser in them, in classes of PIECE_WINDOWS.
                at = 0
                while at < windows:
                    own = (offset - at) // PIECE_WINDOWS
                    stop = min(windows, offset - own * PIECE_WINDOWS + 1)
                    piece = raw[start + at : start + stop + length - 1]
                    # The bytes that every window of this class has, whichever of them are here.
                    high = min(own * PIECE_WINDOWS + PIECE_WINDOWS - 1, length - GRAM)
                    place = start + offset  # of the minimiser
                    core = raw[place - own * PIECE_WINDOWS : place - high + length]
                    key = xxhash.xxh3_64_intdigest(core, seed=(mini ^ own) & (2**64 - 1))
                    unit = xxhash.xxh3_64_intdigest(piece)
                    rows.append((mini, digest, at, p["c"], key - 2**63, unit - 2**63, piece))
                    at = stop
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["mini", "digest", "base", "c", "key", "unit", "raw"])

    return common.map_batches(joined, run, "mini long, digest long, base int, c long, key long, unit long, raw binary")


def covered_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document with any: doc_id, text_key, ranges (array of a, b): bytes inside a repeated window.

    ``docs`` has doc_id, text_key, text.
    """
    spark = docs.sparkSession
    rows = common.cut(_stretch_rows(docs, length), "stretches")
    shared = rows.groupBy("mini").agg(F.count("*").alias("n"), F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("n > 1")
    shared = common.cut(shared.select(F.col("mini").alias("_mini"), (F.col("d1") != F.col("d2")).alias("mixed")), "shared")
    met = common.cut(rows.join(shared, rows["mini"] == shared["_mini"]).drop("_mini"), "met")
    # Equal stretches once, at their first place.
    place = F.struct("doc_id", "text_key", "start")
    distinct = met.filter("mixed").groupBy("mini", "digest").agg(F.count("*").alias("c"), F.min(place).alias("p"), F.first("windows").alias("windows"), F.first("offset").alias("offset"))
    distinct = common.cut(distinct.select("mini", "digest", "c", "p.*", "windows", "offset"), "distinct")
    crowd = distinct.groupBy("mini").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select(F.col("mini").alias("_mini"))
    crowd = common.cut(crowd, "crowded")
    wanted = distinct.join(crowd, distinct["mini"] == crowd["_mini"], "left").withColumn("crowded", F.col("_mini").isNotNull()).drop("_mini")
    units = common.cut(_bytes_of(docs, wanted, length), "units")
    once = units.groupBy("key", "unit").agg(F.sum("c").alias("c"), F.first("raw").alias("raw"))
    total = units.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))

    def sort_shard(table: pa.Table) -> pa.Table:
        found = repeated_windows(table.column("raw").to_pylist(), table.column("c").to_pylist(), length)
        keep = [i for i, r in enumerate(found) if r]
        runs = pa.array([[{"first": a, "last": b} for a, b in found[i]] for i in keep], type=pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        rows = pa.array(keep, type=pa.int64())
        return pa.table({"key": table.column("key").take(rows), "unit": table.column("unit").take(rows), "runs": runs})

    dealt = once.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(int(shards))))
    sorted_ = common.cut(dealt.groupBy("shard").applyInArrow(sort_shard, f"key long, unit long, runs {_RUNS}"), "sorted")
    found = units.select("mini", "digest", "base", "key", "unit").join(sorted_, ["key", "unit"])
    found = found.select("mini", "digest", F.transform("runs", lambda r: F.struct((r["first"] + F.col("base")).alias("first"), (r["last"] + F.col("base")).alias("last"))).alias("runs"))
    found = common.cut(found.groupBy("mini", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs")), "found")
    same = met.filter("not mixed").select("doc_id", "text_key", "start", F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))).alias("runs"))
    other = met.filter("mixed").join(found, ["mini", "digest"]).select("doc_id", "text_key", "start", "runs")
    ranges = same.unionByName(other).select("doc_id", "text_key", F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("a"), (r["last"] + F.col("start") + length).alias("b"))).alias("r"))
    return ranges.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    """Every row of ``docs`` and a column _ranges."""
    keyed = docs.withColumn("__qw_text_key", F.xxhash64("text"))
    plain = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__qw_text_key").alias("text_key"), F.col("text").cast("string").alias("text"))
    ranges = covered_ranges(plain, length).select(F.col("doc_id").alias("__qw_id"), F.col("text_key").alias("__qw_key"), F.col("ranges").alias("__qw_ranges"))
    return keyed.join(ranges, F.col("doc_id").cast("long").eqNullSafe(F.col("__qw_id")) & (F.col("__qw_text_key") == F.col("__qw_key")), "left").drop("__qw_id", "__qw_key", "__qw_text_key")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of each text.

    Texts are UTF-8 bytes, null counts as empty.  Each byte inside a ``length``-byte string that
    also starts anywhere else in the table, the same text included, is removed; overlapping
    occurrences count, every occurrence goes, matches do not cross texts.  Texts shorter than
    ``length`` stay whole.  Repeated rows are different texts and remove each other.  Kept
    bytes need not be valid UTF-8, so ``kept`` is binary.  Extra columns stay, those named like
    a new one are replaced; an empty table gives no rows.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    kept = [c for c in docs.columns if c not in added]
    joined = _with_ranges(docs.select(*kept), length).select(*kept, "__qw_ranges")
    at = kept.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = []
        for text, ranges in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            rest, gone, spans = cut_out(raw, [(r["a"], r["b"]) for r in ranges or []])
            done.append((len(raw), gone, spans, hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*done, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=[*kept, *added])

    from pyspark.sql.types import BinaryType

    schema = StructType([docs.schema[c] for c in kept])
    for c in added[:3]:
        schema = schema.add(c, LongType())
    return common.map_batches(joined, run, schema.add(added[3], StringType()).add(added[4], BinaryType()))
