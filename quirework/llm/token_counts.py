"""Token counts without ids: pieces per distinct pre-token, joined to document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-tokens whose piece count a worker keeps, in two generations.
CACHE_WORDS = 300_000
#: The library's own mark for a space.
SPACE_MARK = "▁"
#: A run of spaces with what follows.  No piece has a space after another character, so no
#: merge crosses the start of such a pre-token.
PRE_TOKENS = re.compile(" +[^ ]*")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a space; its counts cannot be summed over pre-tokens")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def frequencies(self, text: str | None) -> Counter:
        """Pre-token frequencies of a text, each pre-token without its first space."""
        if not text:
            return Counter()
        text = text.replace(SPACE_MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return Counter(text.split(" "))
        return Counter([p[1:] for p in PRE_TOKENS.findall(" " + text)])

    def learn(self, words: set[str]) -> None:
        """Count the pieces of each new pre-token once; the library puts the first space back."""
        new = []
        for w in words:
            if (n := self.old.get(w)) is None:
                new.append(w)
            else:
                self.young[w] = n
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.young.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))
        if "" in words:  # a lone space: the library drops an empty text, so count it before a letter
            self.young[""] = len(self.model.encode(" a", num_threads=1)) - len(self.model.encode("a", num_threads=1))

    def counts(self, texts: list[str | None]) -> list[int]:
        documents = [self.frequencies(t) for t in texts]
        seen: set[str] = set()
        for d in documents:
            seen.update(d)
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.learn(seen - self.young.keys())
        pieces = self.young
        return [sum([pieces[w] * n for w, n in d.items()]) for d in documents]


@lru_cache(maxsize=1)
def _load(path: str) -> PieceCounter:
    return PieceCounter(path)


def load(path: str) -> PieceCounter:
    common.hold_cache("token counts", _load.cache_clear)
    return _load(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes of UTF-8, n_tokens, over_limit (n_tokens > ``limit``).

    Null counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated results; texts of
    any length are counted whole; columns besides doc_id and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = load(vocabulary).counts(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, type=pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.octet_length(common.text_or_empty()).cast("long").alias("n_bytes"),
    )
    return common.map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
