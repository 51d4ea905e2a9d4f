"""Content-defined chunk fingerprints with normalised gear-hash boundaries.

A text is cut where a rolling gear hash of its UTF-8 bytes is small: a strict bound before
the normal chunk size, a loose one after it.  Insertions move boundaries only near by, so
the set of chunk digests, weighted by chunk length, measures how much two texts share.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 8, 32, 128
#: A boundary needs the hash below these: one in 128 bytes before the normal size, one in 8 after.
STRICT, LOOSE = np.uint32(1 << 25), np.uint32(1 << 29)
#: Text bytes of a range of documents to aim at, ranges looked at for each, and ranges up to which their first rows are broadcast.
BUCKET_BYTES, FINE, BROADCAST_BUCKETS = 128 << 20, 4, 100_000
#: Bytes of a digest in a fingerprint; one more holds the length.
DIGEST_BYTES = 5

GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest()[:4] for i in range(256)), dtype="<u4")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, built by doubling windows."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        grown = h.copy()
        grown[step:] += h[:-step] << np.uint32(step)
        h = grown
    return h


def chunk_ends(raw: bytes) -> list[int]:
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(raw, dtype=np.uint8))
    loose = np.flatnonzero(h < LOOSE)
    strict = loose[h[loose] < STRICT].tolist()
    loose = loose.tolist()
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        low, middle, high = start + MIN_CHUNK, min(start + NORMAL_CHUNK, n), min(start + MAX_CHUNK, n)
        at = bisect_left(strict, low - 1)
        if at < len(strict) and strict[at] < middle - 1:
            end = strict[at] + 1
        else:
            at = bisect_left(loose, middle - 1)
            end = loose[at] + 1 if at < len(loose) and loose[at] < high else high
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(text: str) -> dict[bytes, int]:
    """Digest of each distinct chunk to its length in bytes."""
    raw, start, out = text.encode("utf-8"), 0, {}
    digest = xxhash.xxh3_64_digest
    for end in chunk_ends(raw):
        out[digest(raw[start:end])[:DIGEST_BYTES]] = end - start
        start = end
    return out


def fingerprint(weights: dict[bytes, int]) -> str:
    """The digests in order, each with its length, in base 64."""
    return base64.b64encode(b"".join([d + weights[d].to_bytes(1, "big") for d in sorted(weights)])).decode("ascii")


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Bytes in common chunks over those of the larger set; two empty sets are alike."""
    larger = max(sum(a.values()), sum(b.values()))
    return sum([a[d] for d in a.keys() & b.keys()]) / larger if larger else 1.0


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Share of the bytes of ``a`` in chunks of ``b``; an empty set is contained in any."""
    return sum([a[d] for d in a.keys() & b.keys()]) / sum(a.values()) if a else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint of its text, n_chunks.  Null counts as empty: an empty fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [chunk_weights(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(fingerprint, sets), type=pa.string()), pa.array(map(len, sets), type=pa.int64())], names=["doc_id", "fingerprint", "n_chunks"]
        )

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fingerprint string, n_chunks long")


def _bounds(sizes: DataFrame, spark) -> tuple[list[int], int]:
    """Upper bounds of doc_id of all buckets but the last, and the number of buckets.

    ``sizes`` has k (doc_id, null as the least) and bytes.  Approximate quantiles cut it into
    FINE ranges a bucket, whose bytes are summed; neighbours are joined up to the aim.  The
    driver gets a few numbers a bucket.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    if parts == 1:
        return [], 1
    fine = sorted(set(sizes.approxQuantile("k", [i / (FINE * parts) for i in range(1, FINE * parts)], 0.2 / (FINE * parts))))
    edges = [int(x) for x in fine]
    held = sizes.groupBy(_range_of(F.col("k"), edges).alias("r")).agg(F.sum("bytes").alias("bytes")).collect()
    in_range = {r["r"]: r["bytes"] for r in held}
    bounds, filled, aim = [], 0, total / parts
    for i, edge in enumerate(edges):
        filled += in_range.get(i, 0)
        if filled + in_range.get(i + 1, 0) / 2 >= aim:
            bounds.append(edge)
            filled = 0
    return bounds, len(bounds) + 1


def _range_of(k, edges: list[int]):
    """Number of ``edges`` (ascending) below ``k``, looked up in two steps so that many edges cost little."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    whole = F.array(*[F.lit(x) for x in edges]).cast("array<long>")
    heads = F.array(*[F.lit(x) for x in edges[::step]]).cast("array<long>")
    below = F.size(F.filter(heads, lambda e: e < k))  # heads below k; the answer lies in the slice of the last one
    at = F.greatest(below - 1, F.lit(0)) * step
    return (at + F.size(F.filter(F.slice(whole, at + 1, step), lambda e: e < k))).cast("int")


def ordered_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of doc_id, one a partition, each followed by the first row of the next.

    Ranges hold about BUCKET_BYTES of text, or less where that gives more tasks; they decide
    the balance, never the result.  Each ends with a row ``tail`` = 1: the first document after
    it, for the last range the first of all.
    """
    spark = docs.sparkSession
    least = F.lit(-(2**63))
    sizes = docs.select(F.coalesce("doc_id", least).alias("k"), F.octet_length("text").cast("long").alias("bytes"))
    bounds, parts = _bounds(sizes, spark)
    bucket = _range_of(F.coalesce("doc_id", least), bounds)
    firsts = docs.select(bucket.alias("bucket"), F.coalesce("doc_id", least).alias("k")).groupBy("bucket").agg(F.min("k").alias("k")).orderBy("bucket").collect()  # a row a bucket
    tails = [(firsts[(i + 1) % len(firsts)]["k"], r["bucket"]) for i, r in enumerate(firsts)]
    tails = spark.createDataFrame(tails, "_first long, _bucket int")
    rows = docs.select("doc_id", "text", bucket.alias("bucket"), F.coalesce("doc_id", least).alias("_k"))
    side = F.broadcast(tails) if len(firsts) <= BROADCAST_BUCKETS else tails
    extra = rows.join(side, rows["_k"] == tails["_first"]).select("doc_id", "text", F.col("_bucket").alias("bucket"), F.lit(1).alias("tail"))
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("tail")).unionByName(extra)
    return both.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many
    of the next document in ascending doc_id (null first, equal ids by text); after the last
    comes the first.  A lone document is its own next.  Null counts as empty: two empty texts
    are alike (1.0).  Repeated rows stay, each the next of the one before; an empty table
    gives no rows; columns besides doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().cast("string").alias("text"))
    common.small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_edited double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is awaited: doc_id, text, bucket, chunks
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, bucket, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = None
                if held is not None and held[2] == bucket:
                    own = chunk_weights(text)
                    n = len(held[1])
                    k = n // 4
                    edited = held[1][: n - k] + text[:k]
                    new = chunk_weights(edited)
                    out.append((held[0], n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), fingerprint(held[3]), fingerprint(new), likeness(held[3], new), likeness(held[3], own), containment(held[3], new)))
                held = None if tail else (doc_id, text, bucket, chunk_weights(text) if own is None else own)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), *((c, pa.float64()) for c in names[5:])]))

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return ordered_buckets(docs).mapInArrow(run, schema)
