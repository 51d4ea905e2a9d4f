"""Text search by the presence of terms, and snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_fold, col


def presence_score(text: Column | str, terms: Sequence[str]) -> Column:
    """How many folded terms occur in the folded text."""
    low = alnum_fold(text)
    folded = [t for t in ("".join(c.lower() for c in term if c.isalnum()) for term in terms) if t]
    return sum((F.contains(low, F.lit(t)).cast("int") for t in folded), F.lit(0))


def snippet(text: Column | str, terms: Sequence[str], size: int = 300, before: int = 90) -> Column:
    """``size`` characters from ``before`` ahead of the first hit, dots where text is left out."""
    x = F.coalesce(col(text), F.lit(""))
    low = F.lower(x)
    hits = F.filter(F.array(*[F.locate(t.lower(), low) for t in terms if t]), lambda p: p > 0)
    start = F.when(F.size(hits) > 0, F.greatest(F.array_min(hits) - 1 - before, F.lit(0))).otherwise(0)
    body = F.replace(F.substring(x, start + 1, F.lit(size)), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + size < F.char_length(x), "...").otherwise(""))


def term_search(df: DataFrame, text: str, terms: Sequence[str], order: Sequence[str], least: int = 2, limit: int = 10) -> DataFrame:
    """The ``limit`` best rows with at least ``least`` terms; a top-k, so nothing is sorted whole."""
    scored = df.withColumn("score", presence_score(text, terms)).filter(F.col("score") >= least)
    return scored.withColumn("snippet", snippet(text, terms)).orderBy(F.desc("score"), *order).limit(limit)
