"""Quality, completeness and publication gates, and the job log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import quality_points

CODE_SHAPE = "^[A-Z]{2,10}-[A-Z0-9]{1,4}$"


def completeness_issues(rules: Sequence[tuple[Column, Column, str]]) -> Column:
    """Messages of the rules (source has it, record has it, message) where only the source has it."""
    return F.filter(F.array(*[F.when(F.coalesce(has, F.lit(False)) & ~F.coalesce(kept, F.lit(False)), F.lit(text)) for has, kept, text in rules]), lambda m: m.isNotNull())


def publishable(code: Column, issues: Column, applications: Column, useful: Sequence[Column], least: int = 2) -> Column:
    """A well-formed code, no issue, an application, and enough useful sections."""
    filled = sum((F.coalesce(u, F.lit(False)).cast("int") for u in useful), F.lit(0))
    return F.rlike(F.coalesce(code, F.lit("")), F.lit(CODE_SHAPE)) & (F.size(issues) == 0) & (applications > 0) & (filled >= least)


def status(published: Column, verified: Column, issues: Column) -> Column:
    """published, awaiting_verification, rejected or needs_review, tried in that order."""
    return (
        F.when(F.coalesce(published & verified, F.lit(False)), "published")
        .when(F.coalesce(published & ~verified, F.lit(False)), "awaiting_verification")
        .when(F.size(issues) > 0, "rejected")
        .otherwise("needs_review")
    )


def record_score(weights: Sequence[tuple[Column, int]]) -> Column:
    """Weighted sizes of the parts of a record; null parts count nothing."""
    return sum((F.coalesce(n, F.lit(0)).cast("long") * w for n, w in weights), F.lit(0).cast("long"))


def latest_jobs(log: DataFrame, now: str, job: str = "job", at: str = "at", state: str = "state", stale: str = "INTERVAL 12 HOURS", limit: int | None = None) -> DataFrame:
    """Last state of each job; a running one without news for ``stale`` counts as interrupted."""
    last = log.groupBy(job).agg(F.max(at).alias("updated"), F.max_by(state, F.struct(at, state)).alias("last_state"))
    old = (F.col("last_state") == "running") & (F.col("updated") < F.lit(now).cast("timestamp") - F.expr(stale))
    out = last.withColumn("last_state", F.when(old, "interrupted").otherwise(F.col("last_state")))
    return out.orderBy(F.desc("updated"), job).limit(limit) if limit else out


def keep_latest(log: DataFrame, group: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` entries of each group; of equal ones those with the greater values of the other columns, in column order."""
    rest = [F.desc(c) for c in log.columns if c != order and c not in group]
    w = Window.partitionBy(*group).orderBy(F.desc(order), *rest)
    return log.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def cache_misses(work: DataFrame, cache: DataFrame, parts: Sequence[str], version: str) -> DataFrame:
    """Work whose content key (version and parts, hashed) the cache lacks, with the key."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(version), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    return work.withColumn("cache_key", key).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def best_prior(candidates: DataFrame, key: str, issue_count: str, order: str) -> DataFrame:
    """The candidate with fewest issues for each key; ties go to the first by ``order``."""
    w = Window.partitionBy(key).orderBy(issue_count, order)
    return candidates.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def best_read(reads: DataFrame, keys: Sequence[str], text: str, place: str) -> DataFrame:
    """Of several reads of the same page the one of the best quality, with points; of equal ones the first by ``place``.

    An arg-max with map-side combine: no task holds all reads of a page.
    """
    scored = reads.withColumn("points", quality_points(text))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in scored.columns if c not in keys]), F.struct("points", -F.col(place))).alias("_best"))
    return best.select(*keys, "_best.*")
