"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontamination, divergence, fingerprints, html_extraction, line_dedup, ngram_join, oracles, periodic_runs, sentence_pieces, substring_dedup, token_counts, token_files, toxicity

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/quirework/token-files-{uuid.uuid4().hex}"
    token_files.write(docs, common.tokenizer_path(WORD_VOCABULARY), path)
    return token_files.read(spark, path, with_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, common.tokenizer_path(PIECE_VOCABULARY))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(common.read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(common.text_or_empty().cast("binary"), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(common.read_table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, common.tokenizer_path(WORD_VOCABULARY))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(common.read_table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return sentence_pieces.round_trip_digests(docs, common.tokenizer_path(PIECE_VOCABULARY))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.read_table(spark, sf_dir, "documents"))


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, the words that make its tail periodic; none where doc_id is null."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapse(common.read_table(spark, sf_dir, "documents"), periodic_tail)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_fingerprints": op10_fingerprints,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op12_source_divergence": oracles.SOURCE_DIVERGENCE,
}
