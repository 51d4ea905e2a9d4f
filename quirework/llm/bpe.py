"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file fixes the normaliser, the pre-token pattern and the merges.  Words
that a worker has not met are laid out in one flat symbol array; each round looks up all
adjacent pairs at once by binary search over the sorted pair keys, takes the lowest rank
of every word, merges its occurrences from left to right and drops words without a merge.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chunks (white-space separated strings) whose encoding a worker keeps, in two generations.
CACHE_CHUNKS = 250_000
NO_RANK = np.int64(2**62)
#: Split by str.split() but no white space to the vocabulary's pattern.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word-end symbols."""

    def __init__(self, path: str, cache_chunks: int | None = None):
        self.cache_chunks = cache_chunks
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in added.items()})
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.base = max(self.tokens) + 1
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        made = np.full(self.base, -1, dtype=np.int64)
        made[self.results[::-1]] = np.arange(len(merges))[::-1]
        #: Batched rounds equal one-at-a-time merging when no merge is ranked before its parts.
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        #: The same by pre-token.
        self.coded: dict[str, tuple[str, str]] = {}

    def bound(self) -> int:
        return self.cache_chunks or CACHE_CHUNKS

    # -- merge rounds -------------------------------------------------------------------

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            rank = np.full(len(symbols), NO_RANK)
            if len(symbols) > 1:
                key = symbols[:-1] * self.base + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = (self.keys[at] == key) & (owner[1:] == owner[:-1])
                rank[:-1][known] = self.ranks[at[known]]
            lowest = np.minimum.reduceat(rank, starts)
            open_word = lowest < NO_RANK
            if not open_word.all():
                keep = np.repeat(open_word, sizes)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lowest, sizes = lowest[open_word], sizes[open_word]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            if self.ordered:  # of overlapping occurrences (a a a) every second one goes
                where = np.flatnonzero(hit)
                run = np.r_[True, np.diff(where) != 1]
                first = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
                where = where[(where - first) % 2 == 0]
            else:  # one merge a word and round
                where = np.flatnonzero(hit)
                where = where[np.r_[True, owner[where][1:] != owner[where][:-1]]]
            symbols[where] = self.results[rank[where]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        flat = symbols[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    # -- texts --------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """White-space separated strings; no pre-token crosses white space."""
        if NOT_SPACE.search(text):
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are new to this worker, all in the same merge rounds."""
        if not chunks:
            return
        new, unknown, find, old = [], {}, self.words.findall, self.old
        if len(self.coded) > self.bound():
            self.coded = {}
        coded = self.coded
        for chunk in chunks:
            if (known := old.get(chunk)) is not None:
                self.young[chunk] = known
                continue
            # Each code point is lowered by itself: no final sigma.
            low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            if low.isalpha():
                parts = (low,)
            elif low[-1] in ".," and low[:-1].isalpha():
                parts = (low[:-1], low[-1])
            else:
                parts = find(low)
            new.append((chunk, parts))
            for p in parts:
                if p not in coded:
                    unknown[p] = None
        for word, ids in zip(unknown, self.merge(list(unknown)), strict=True):
            coded[word] = (" ".join(map(str, ids)), self.decode(ids))
        for chunk, parts in new:
            if len(parts) == 1:
                self.young[chunk] = coded[parts[0]]
            else:
                got = [coded[p] for p in parts]
                self.young[chunk] = (" ".join([x[0] for x in got]), " ".join([x[1] for x in got]))

    def decode(self, ids) -> str:
        """The tokens joined by one space: the file names no decoder.  Unknown ids give nothing."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])

    def encode_texts(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Per text: its ids in decimal joined by a space, and the decoded text."""
        if self.special is None:
            cut = [[(text, False)] for text in texts]
        else:
            cut = [[(p, p in self.added) for p in self.special.split(text)] if text and "<|" in text else [(text or "", False)] for text in texts]
        split = [[p if special else self.chunks(p) for p, special in parts] for parts in cut]
        fresh: set[str] = set()
        for parts in split:
            for p in parts:
                if not isinstance(p, str):
                    fresh.update(p)
        if len(self.young) > self.bound():
            self.old, self.young = self.young, {}
        self.learn(fresh - self.young.keys())
        young, out = self.young, []
        for parts in split:
            got: list[tuple[str, str]] = []
            for p in parts:
                if isinstance(p, str):
                    got.append((str(self.added[p]), p))
                else:
                    got += [young[c] for c in p]
            out.append((" ".join([x[0] for x in got]), " ".join([x[1] for x in got])))
        return out


@lru_cache(maxsize=1)
def _load(path: str, cache_chunks: int | None) -> WordBpe:
    return WordBpe(path, cache_chunks)


def load(path: str, cache_chunks: int | None = None) -> WordBpe:
    common.hold_cache("bpe", _load.cache_clear)
    return _load(path, cache_chunks)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` array<int>: the ids of ``text``; null counts as empty.

    Extra columns stay; a column named like ``ids`` is replaced.  Repeated rows stay
    repeated; texts of any length are encoded whole; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != ids]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = load(vocabulary).encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist())
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        values = pa.array([[int(x) for x in s.split()] for s, _ in coded], type=pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*arrays, values], names=[*kept, ids])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([docs.schema[c] for c in kept]).add(ids, ArrayType(IntegerType()))
    return common.map_batches(docs.select(*kept), run, schema)


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with ``text``: the decoded ids; null ids give an empty string, unknown ids nothing."""
    kept = [c for c in coded.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary)
        texts = [bpe.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, type=pa.string())], names=[*kept, text])

    from pyspark.sql.types import StringType, StructType

    schema = StructType([coded.schema[c] for c in kept]).add(text, StringType())
    return common.map_batches(coded, run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, with_ids: bool = False, cache_chunks: int | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text.

    Null and empty texts have no tokens and the digest of the empty string; repeated rows
    give repeated results; columns besides doc_id and text are not read.  ``with_ids`` adds
    the ids themselves, array<int>; ``cache_chunks`` bounds what a worker keeps.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = load(vocabulary, cache_chunks).encode_texts(batch.column(1).to_pylist())
        columns = [
            batch.column(0),
            pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in coded], type=pa.int64()),
            pa.array([hashlib.sha256(ids.encode("ascii")).hexdigest() for ids, _ in coded], type=pa.string()),
            pa.array([hashlib.sha256(text.encode("utf-8")).hexdigest() for _, text in coded], type=pa.string()),
        ]
        if with_ids:
            columns.append(pa.array([list(map(int, ids.split())) for ids, _ in coded], type=pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, run, schema)
