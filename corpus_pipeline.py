"""A training-corpus pipeline: toxic documents out, repeated lines out, one of each group of
near copies, contaminated documents out, then token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import bpe, common, decontamination, line_dedup, ngram_join, toxicity
from quirework.llm.queries import WORD_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; nothing else changes."""
    return toxicity.reject_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from their later places; n_chars follows the text.

    A document that is nothing but repeated runs goes with them: no later stage could tell it
    from a text that was empty from the start.
    """
    return line_dedup.without_repeats(docs, "n_chars" if "n_chars" in docs.columns else None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark n-gram go."""
    return decontamination.remove_documents(docs, common.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of the decoded text.

    Executors come here with the heaps of four stages, so their workers keep less than usual.
    """
    return bpe.round_trip_digests(docs, common.tokenizer_path(WORD_VOCABULARY), with_ids=True, cache_chunks=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, docs = docs, common.cut(out, f"pipeline-{name}")
            common.discard(before)
        else:
            docs = out
    return docs
