"""Lookups of requests (make, model, year) in interval-valued applications.

``applications``: make, model, year_from, year_to, code.  ``requests``: make, model, year.
Names compare without case.  Every choice has a total order: after the stated keys come
year_from, year_to and code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQUEST = ("make", "model", "year")


def _candidates(requests: DataFrame, applications: DataFrame) -> DataFrame:
    """Requests joined to the applications of their make and model; equi keys, so it shuffles by them."""
    r = requests.select(*[F.col(c).alias(f"q_{c}") for c in REQUEST]).distinct()
    a = applications.select("make", "model", "year_from", "year_to", "code")
    return r.join(a, (F.lower(r["q_make"]) == F.lower(a["make"])) & (F.lower(r["q_model"]) == F.lower(a["model"])))


def _first(df: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*[f"q_{c}" for c in REQUEST]).orderBy(*order, "year_from", "year_to", "code")
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _named(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.col(f"q_{c}").alias(c) for c in REQUEST], "year_from", "year_to", "code", *more)


def covered() -> Column:
    return F.col("q_year").between(F.col("year_from"), F.col("year_to"))


def nearest_order() -> tuple[Column, ...]:
    return F.when(covered(), 0).otherwise(1), F.abs(F.col("year_from") - F.col("q_year")), F.desc("year_to")


def exact(requests: DataFrame, applications: DataFrame) -> DataFrame:
    """The narrowest range that covers the year; requests without one give no row."""
    return _named(_first(_candidates(requests, applications).filter(covered()), F.col("year_to") - F.col("year_from")))


def nearest(requests: DataFrame, applications: DataFrame) -> DataFrame:
    """A covering range first, then the closest start, then the latest end."""
    return _named(_first(_candidates(requests, applications).withColumn("covered", covered()), *nearest_order()), "covered")


def tiered(requests: DataFrame, applications: DataFrame, published: DataFrame, display: str | None = None) -> DataFrame:
    """Best-effort match in six tiers.

    1 the best covering row of the raw model, if its system is published; 2 any published row
    of the raw model; 3 the best covering row unpublished; 4 the nearest row whose ``display``
    name is the requested model, if published; 5 any published row of that name; 6 the row of 4
    unpublished, else the nearest of the raw model.  Tiers 1 and 4 rank first and test after: a
    published row further down does not count there.  Without ``display`` (a column of
    ``applications``) tiers 4 and 5 are empty.  ``published``: code.
    """
    keys = [f"q_{c}" for c in REQUEST]
    tie = ("year_from", "year_to", "code")
    p = published.select(F.col("code").alias("_p")).distinct()
    base = _candidates(requests, applications).withColumn("_raw", F.lit(True))
    if display:
        shown = applications.filter(F.col(display) != "").withColumn("model", F.col(display))
        base = base.unionByName(_candidates(requests, shown).withColumn("_raw", F.lit(False)))
    marked = base.join(p, base["code"] == p["_p"], "left").withColumn("_published", F.col("_p").isNotNull()).drop("_p").withColumn("covered", covered())
    width = Window.partitionBy(*keys, "_raw").orderBy(F.when(F.col("covered"), 0).otherwise(1), F.col("year_to") - F.col("year_from"), *tie)
    near = Window.partitionBy(*keys, "_raw").orderBy(*nearest_order(), *tie)
    ranked = marked.withColumn("_exact", F.col("covered") & (F.row_number().over(width) == 1)).withColumn("_nearest", F.row_number().over(near) == 1)
    raw = F.when(F.col("_exact") & F.col("_published"), 1).when(F.col("_published"), 2).when(F.col("_exact"), 3).otherwise(7)
    named = F.when(F.col("_nearest") & F.col("_published"), 4).when(F.col("_published"), 5).when(F.col("_nearest"), 6)
    tiers = ranked.withColumn("_tier", F.when(F.col("_raw"), raw).otherwise(named)).filter("_tier is not null")
    best = Window.partitionBy(*keys).orderBy("_tier", *nearest_order(), *tie)
    return _named(tiers.withColumn("tier", F.least("_tier", F.lit(6))).withColumn("_rank", F.row_number().over(best)).filter("_rank = 1"), "tier")


def representative(applications: DataFrame) -> DataFrame:
    """Per code the application that starts first, of those the one that ends last."""
    w = Window.partitionBy("code").orderBy("year_from", F.desc("year_to"), "make", "model")
    return applications.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def interval_members(intervals: DataFrame, start: str, end: str, points: DataFrame, point: str) -> DataFrame:
    """Each interval [start, end] of whole numbers joined to the rows at its points."""
    spread = intervals.filter(F.col(end) >= F.col(start)).withColumn("_at", F.explode(F.sequence(F.col(start), F.col(end))))
    return spread.join(points, spread["_at"] == points[point]).drop("_at")


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that match every given value; a null column matches anything, an empty value asks nothing."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name).isNull() | (F.col(name) == F.lit(value)))
    return df


def column_of(ratio: Column, columns: dict[str, tuple[float, float]]) -> Column:
    """The first half-open range [start, end) that holds the ratio; null if none does."""
    out = None
    for name, (a, b) in columns.items():
        test = (ratio >= a) & (ratio < b)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out
