"""Similarity of names and texts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

ACCEPT, CONTAINED = 0.78, 0.9
#: PostgreSQL's default bound of trigram similarity.
TRIGRAM_BOUND = 0.3


def fold(value: str) -> str:
    return "".join(c.lower() for c in value if c.isalnum())


def best_match(name: str, choices: Sequence[str]) -> tuple[str, float]:
    """The first best choice by ratio, containment counting 0.9 at least; the name itself below the bound."""
    mine, best, top = fold(name), name, 0.0
    for choice in choices:
        other = fold(choice)
        score = SequenceMatcher(None, mine, other).ratio()
        if mine in other or other in mine:
            score = max(score, CONTAINED)
        if score > top:
            best, top = choice, score
    return (best if top >= ACCEPT else name), top


def canonicalize(df: DataFrame, vocabulary: Mapping[str, Sequence[str]], key: str, name: str) -> DataFrame:
    """``df`` with canonical and score: ``name`` against the vocabulary of ``key``.

    Each distinct pair is scored once, in Arrow batches, and joined back; the vocabulary is a
    parameter of the program, so its size is known.
    """

    @F.pandas_udf("canonical string, score double")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, names in batches:
            rows = [best_match(n, vocabulary.get(k, ())) if vocabulary.get(k) else (n, 0.0) for k, n in zip(keys, names, strict=True)]
            yield pd.DataFrame(rows, columns=["canonical", "score"])

    pairs = df.select(F.coalesce(col(key), F.lit("")).alias("_k"), F.coalesce(col(name), F.lit("")).alias("_n")).distinct()
    scored = pairs.withColumn("m", match("_k", "_n")).select("_k", "_n", "m.canonical", "m.score")
    return df.join(scored, (F.coalesce(col(key), F.lit("")) == scored["_k"]) & (F.coalesce(col(name), F.lit("")) == scored["_n"]), "left").drop("_k", "_n")


def display_names(df: DataFrame, vocabulary: Mapping[str, Sequence[str]], key: str, name: str, suspicious: Column) -> DataFrame:
    """``df`` with display: the canonical name where the key is known or the name suspicious, empty if none fits; else the name.

    The key is compared as it is written.
    """
    known = F.coalesce(F.col(key), F.lit("")).isin(*vocabulary) if vocabulary else F.lit(False)
    scored = canonicalize(df.withColumn("_checked", known | F.coalesce(suspicious, F.lit(False))), vocabulary, key, name)
    shown = F.when(F.col("_checked"), F.when(F.col("score") >= ACCEPT, F.col("canonical")).otherwise("")).otherwise(F.col(name))
    return scored.withColumn("display", shown).drop("_checked", "canonical", "score")


def decoder_fold(x: Column | str) -> Column:
    """Upper case, I read as 1 and O as 0, letters and digits alone."""
    return F.regexp_replace(F.translate(F.upper(col(x)), "IO", "10"), "[^A-Z0-9]+", "")


def trigrams(x: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(col(x)), "[^a-z0-9]+"), lambda w: w != "")
    parts = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))


def similar_pairs(df: DataFrame, name: str, bound: float = TRIGRAM_BOUND) -> DataFrame:
    """Pairs a < b of distinct names with trigram similarity >= ``bound``, joined over shared trigrams.

    Only pairs that share a trigram meet.
    """
    names = df.select(F.col(name).alias("n")).distinct().withColumn("t", trigrams("n"))
    grams = names.select("n", F.size("t").alias("size"), F.explode("t").alias("g"))
    other = grams.select(F.col("n").alias("b"), F.col("size").alias("size_b"), "g")
    shared = grams.join(other, "g").filter("n < b").groupBy(F.col("n").alias("a"), "b").agg(F.count("*").alias("c"), F.first("size").alias("sa"), F.first("size_b").alias("sb"))
    score = F.col("c") / (F.col("sa") + F.col("sb") - F.col("c"))
    return shared.select("a", "b", score.alias("similarity")).filter(F.col("similarity") >= bound)
