"""Token-id files: ids of documents in doc_id order, in frames of range-coded blocks.

A file row is one frame: the documents it holds, their lengths, and their ids as a frame of
independently reset, checksummed blocks (see ``range_coder``).  No document is split over two
rows.  The rows of a range of doc_id lie in one partition, in order; the folder is written and
read through Spark, so it may be in any store.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, range_coder
from .fingerprints import ordered_buckets

END_ID = 1
#: Ids of a frame to aim at: LANES blocks, which are coded together.
FRAME_IDS = range_coder.LANES * range_coder.BLOCK_IDS
CACHE_CHUNKS = 400_000
LIBRARY_BATCH = 256
#: Bytes of text to encode together.
GATHERED_BYTES = 8 << 20
#: A word that the library meets alone between chunks; its id tells them apart.
BETWEEN = "\x01"
#: Small letters that normalisation leaves alone.
PLAIN = "^[a-zà-öø-ÿ]+$"
#: Texts with these are cut at white space only: a comma or full stop that the pattern may join to what is before
#: it, a capital that may be composed with a mark before it is made small.
UNFOLDED = r"[^A-Za-z0-9À-ÖØ-öø-ÿ\s][.,]|[A-Z]\p{M}"

_ROWS = "bucket int, seq int, offset long, n long, doc_ids array<long>, lengths array<long>, frame binary"


def _kinds(chunks: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Plain words, other chunks, and those with the word that stands between chunks."""
    plain = pc.match_substring_regex(pa.array(chunks, pa.large_string()), PLAIN).to_numpy(zero_copy_only=False).tolist()
    other = list(compress(chunks, map(not_, plain)))
    return list(compress(chunks, plain)), [c for c in other if BETWEEN not in c], [c for c in other if BETWEEN in c]


class LibraryEncoder:
    """The tokenizers library behind a table of white-space separated chunks.

    The vocabulary's pattern never crosses white space and its normaliser works within it, so
    the ids of a text are those of its chunks in a row.  Only ASCII white space cuts; texts with
    an added token go to the library whole.  As the pattern ends a word before a comma or full
    stop and the normaliser makes letters small, both are done to the texts first, where that
    is sure to change no id; fewer chunks are different then.  Arrow cuts the texts and numbers
    their chunks, so Python meets each different chunk of a batch once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.between = self._alone([BETWEEN])[0]
        # The same merges for words that the normaliser leaves alone and the pattern does not cut.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), LIBRARY_BATCH):  # the library's results are large until they are packed
            part = texts[at : at + LIBRARY_BATCH]
            out += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _joined(self, library, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; many go to the library as one text, with a word of their own between them."""
        if len(self.between) != 4:
            return self._alone(chunks)
        out: list[bytes] = []
        for at in range(0, len(chunks), LIBRARY_BATCH):
            part = chunks[at : at + LIBRARY_BATCH]
            ids = np.array(library.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == np.frombuffer(self.between, dtype="<u4")[0])
            if len(ends) != len(part) - 1:
                raise ValueError("chunks of the library cannot be told apart")
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)]
        return out

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, from the tables or the library."""
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        young = self.young
        out = list(map(young.get, chunks))
        missed = [i for i, ids in enumerate(out) if ids is None]
        asked = [chunks[i] for i in missed]
        found = list(map(self.old.get, asked))
        fresh = [c for c, ids in zip(asked, found, strict=True) if ids is None]
        young.update((c, ids) for c, ids in zip(asked, found, strict=True) if ids is not None)
        for kind, encode in zip(_kinds(fresh), (lambda c: self._joined(self.plain, c), lambda c: self._joined(self.library, c), self._alone), strict=True):
            young.update(zip(kind, encode(kind), strict=True))
        for i, ids in zip(missed, map(young.__getitem__, asked), strict=True):
            out[i] = ids
        return out

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (little-endian unsigned 32-bit), each text followed by ``end``, and the place where each begins, with the end of the last."""
        # A copy: Arrow's lower-casing misreads slices.
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        whole = np.zeros(len(texts), dtype=bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(whole)
        words = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if len(odd) else texts
        folded = pc.replace_substring(pc.replace_substring(pc.ascii_lower(words), ",", " ,"), ".", " .")
        cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(words, UNFOLDED), words, folded))
        coded = cut.flatten().dictionary_encode()
        parts = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # What follows each text is one more chunk: the ids of texts that went whole, then the end.
        parts += [ids + end for ids in self._alone(texts.take(pa.array(odd)).to_pylist())]
        parts.append(end)
        last = np.full(len(texts), len(parts) - 1)
        last[odd] = len(parts) - 1 - len(odd) + np.arange(len(odd))
        offsets = cut.offsets.to_numpy()
        bounds = offsets[1:] - offsets[0]
        chunk = np.insert(coded.indices.to_numpy(zero_copy_only=False), bounds, last)
        taken = pa.array(parts, pa.large_binary()).take(pa.array(chunk))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[1 : len(taken) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", dtype="<u4")
        return ids, np.concatenate([[0], ends[bounds + np.arange(len(texts))]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encoder(path: str) -> LibraryEncoder:
    common.hold_cache("token files", _encoder.cache_clear)
    return _encoder(path)


def _frame(bucket: int, seq: int, offset: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    lengths = [len(p) for p in parts]
    frame = range_coder.encode(np.concatenate(parts))
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([offset], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([docs], longs), pa.array([lengths], longs), pa.array([frame], pa.binary())],
        names=[c.split()[0] for c in _ROWS.split(", ")],
    )


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in larger ones: chunks that texts share are looked up once in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` to each, and write the files to the folder ``path``.

    Documents go in ascending doc_id, null first, equal ids by text; null texts count as empty
    and have the end id alone.  An empty table gives an empty folder with a schema.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().cast("string").alias("text"))
    common.small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        parts: list[np.ndarray] = []
        bucket, seq, offset, size = None, 0, 0, 0
        for batch in gathered(batches):
            ids, buckets, tails = (batch.column(i).to_pylist() for i in (0, 2, 3))
            own = [i for i, t in enumerate(tails) if not t]
            coded, at = encoder(vocabulary).encode_array(batch.column(1).take(pa.array(own, type=pa.int64())), end)
            for i, a, b in zip(own, at[:-1].tolist(), at[1:].tolist(), strict=True):
                if held and (buckets[i] != bucket or size + b - a > FRAME_IDS):
                    yield _frame(bucket, seq, offset, held, parts)
                    seq, offset = seq + 1, offset + size
                    held, parts, size = [], [], 0
                if buckets[i] != bucket:
                    bucket, seq, offset = buckets[i], 0, 0
                held.append(ids[i])
                parts.append(coded[a:b])
                size += b - a
        if held:
            yield _frame(bucket, seq, offset, held, parts)

    spark = docs.sparkSession
    frames = spark.createDataFrame([], _ROWS) if docs.isEmpty() else ordered_buckets(rows).mapInArrow(run, _ROWS)
    frames.write.mode("overwrite").parquet(path)


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, and ids (binary, little-endian) if asked for.

    ``start`` counts the ids of all documents before it in the order of the files.  A block
    that does not match its checksum fails the read.
    """
    frames = spark.read.schema(_ROWS).parquet(path)
    sizes = frames.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()  # a row a range, as many as were written
    starts = np.cumsum([0, *[r["n"] for r in sizes]])[:-1].tolist()
    base = spark.createDataFrame([(r["bucket"], int(s)) for r, s in zip(sizes, starts, strict=True)], "bucket int, base long")
    # A frame is large: a few rows make a batch.
    common.small_batches(spark)
    placed = frames.join(F.broadcast(base), "bucket").select((F.col("base") + F.col("offset")).alias("start"), "doc_ids", "lengths", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_cache("frames", lambda: None)
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, lengths, frame = (batch.column(k)[i].as_py() for k in range(4))
                ids = memoryview(range_coder.decode(frame)).cast("B")
                ends = np.cumsum(np.array([0, *lengths], dtype=np.int64))
                parts = [ids[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(ends[:-1] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return placed.mapInArrow(run, schema)
