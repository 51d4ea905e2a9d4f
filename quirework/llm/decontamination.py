"""Benchmark decontamination with DataFrame functions alone.

The distinct word n-grams of the benchmark are the build side of a broadcast hash join;
every word window of a document probes it.  The join key is the normalised n-gram itself,
so a hash hit is verified by equality in the same step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 10
#: Fixed value of the contract: a word is a run of these, after lower-casing A-Z.
WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Distinct n-grams up to which the build side is broadcast (about 100 bytes each); beyond
#: it Spark joins by shuffle.
BROADCAST_NGRAMS = 500_000


def words_of(text):
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD_PATTERN), 0)


def _windows(words, size: int):
    """Every window of ``size`` consecutive words as struct(pos, gram); none if there are fewer."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.array_join(F.slice(words, i, size), " ").alias("gram"))),
    ).otherwise(F.array().cast("array<struct<pos:int,len:int,gram:string>>"))


def benchmark_ngrams(benchmark: DataFrame, window: int = WINDOW_WORDS, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct n-grams: gram, len, items (sorted array of the item ids, as strings)."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    short = F.array(F.struct(F.lit(1).alias("pos"), F.size("w").alias("len"), F.array_join("w", " ").alias("gram")))
    rows = words.select("item", F.explode(F.when(F.size("w") < window, short).otherwise(_windows(F.col("w"), window))).alias("g"))
    return rows.groupBy("g.gram", "g.len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Per distinct (doc_id, text) of ``docs``: its word count and sorted hit windows (pos, len, items)."""
    grams = common.cut(benchmark_ngrams(benchmark, window), "ngrams")
    # At most ``window`` numbers: the lengths of the items that have fewer words than a window.
    size = grams.groupBy("len").count().collect()
    if sum(r["count"] for r in size) <= BROADCAST_NGRAMS:
        grams = F.broadcast(grams)
    lengths = sorted(r["len"] for r in size)
    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    # One entry before the windows carries the word count, so that the table is read once.
    head = F.array(F.struct(F.lit(0).alias("pos"), F.size("w").alias("len"), F.lit(None).cast("string").alias("gram")))
    probes = words.select("doc_id", "text_key", F.explode(F.concat(head, *[_windows(F.col("w"), n) for n in lengths])).alias("p"))
    probes = probes.select("doc_id", "text_key", "p.pos", F.col("p.len").alias("n"), "p.gram")
    found = probes.join(grams.select("gram", F.col("len").alias("n"), "items"), ["gram", "n"], "left").filter("items is not null or pos = 0")
    return found.groupBy("doc_id", "text_key").agg(
        F.max(F.when(F.col("pos") == 0, F.col("n"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "n")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("pos") > 0, F.col("items")))))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key, windows.

    A window is ``window`` consecutive words of a benchmark item, or the whole of a shorter
    one.  A document word inside any occurrence of a window is hit.  ``windows`` holds the hit
    windows as (pos from 1, n).  Null and empty texts have no words; null or wordless items
    have no window; an empty benchmark hits nothing.  Rows equal in doc_id and text give one
    row.  Columns besides doc_id and text are not read.
    """
    covered = F.aggregate(
        "windows",
        F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("n")),
        lambda a, w: F.struct(
            F.greatest(a["next"], w["pos"] + w["n"]).alias("next"),
            (a["n"] + F.greatest(F.lit(0), w["pos"] + w["n"] - F.greatest(a["next"], w["pos"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return _hits(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("windows") > 0).alias("contaminated"),
        "text_key",
        "windows",
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the contaminated ones; every column and every other row stays.

    A null doc_id never equals another, so it is compared null-safely.
    """
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("__qw_bad_id"), F.col("text_key").alias("__qw_bad_key"))
    keyed = docs.withColumn("__qw_text_key", F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__qw_bad_id")) & (F.col("__qw_text_key") == F.col("__qw_bad_key")), "left_anti").drop("__qw_text_key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``.

    Each hit word goes with the characters up to the next word; other characters stay as they
    are.  Documents without a hit keep their text unchanged, null included.
    """
    spans = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("__qw_id"), F.col("text_key").alias("__qw_key"), F.col("windows").alias("__qw_windows"))
    joined = docs.withColumn("__qw_text_key", F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col("__qw_id")) & (F.col("__qw_text_key") == F.col("__qw_key")), "left")
    # A word with what follows it, after what precedes the first word.
    rest = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
    parts = F.regexp_extract_all("text", F.lit(rest), 0)
    before = F.regexp_extract("text", "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    hit = F.aggregate(
        "__qw_windows",
        F.array().cast("array<int>"),
        lambda a, w: F.concat(a, F.when(F.greatest(w["pos"], F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0))) < w["pos"] + w["n"], F.sequence(F.greatest(w["pos"], F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0))), w["pos"] + w["n"] - 1)).otherwise(F.array().cast("array<int>"))),
    )
    kept = F.array_join(F.concat(F.array(before), F.filter(parts, lambda p, i: ~F.array_contains(F.col("__qw_hit"), i + 1))), "")
    return (
        joined.withColumn("__qw_hit", F.when(F.col("__qw_id").isNotNull() | F.col("__qw_windows").isNotNull(), hit))
        .withColumn("text", F.when(F.col("__qw_hit").isNull(), F.col("text")).otherwise(kept))
        .drop("__qw_text_key", "__qw_id", "__qw_key", "__qw_windows", "__qw_hit")
    )
