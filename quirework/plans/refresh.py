"""Rebuild of drafts by what changed: sections whose sources are the same keep their drafts.

A section's source is its text, its span and the applications of its code; a digest of them is
kept with each draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drafts

KEY = ("code", "source_document", "page_start")


def sourced(secs: DataFrame, applications: DataFrame) -> DataFrame:
    """``secs`` with source_key, the digest of all that a draft is made of."""
    listed = applications.groupBy(F.col("system_code").alias("_code")).agg(F.to_json(F.array_sort(F.collect_set(F.struct("make", "model", "year_from", "year_to")))).alias("_apps"))
    joined = secs.join(listed, secs["code"] == listed["_code"], "left")
    parts: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("code", "page_start", "page_end", "raw_text", "_apps")]
    return joined.withColumn("source_key", F.sha2(F.concat_ws("\x1f", *parts), 256)).drop("_code", "_apps")


def refresh(secs: DataFrame, applications: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """code, source_document, page_start, page_end, source_key, draft, rebuilt: the drafts of all sections.

    A draft of ``previous`` (an earlier result) stays where code, document, first page and
    source_key are the same; all others are made, and those of sections that are gone go.  Only
    keys meet the earlier result; texts are read for what is rebuilt alone.
    """
    keyed = sourced(secs, applications)
    columns = [*KEY, "page_end", "source_key"]
    if previous is None:
        return drafts.draft(keyed, applications).select(*columns, "draft", F.lit(True).alias("rebuilt"))
    on = [*KEY, "source_key"]
    old = previous.select(*on, "draft").dropDuplicates(on)
    kept = keyed.select(*columns).join(old, on).select(*columns, "draft", F.lit(False).alias("rebuilt"))
    changed = keyed.join(old.select(*on), on, "left_anti")
    made = drafts.draft(changed, applications).select(*columns, "draft", F.lit(True).alias("rebuilt"))
    return kept.unionByName(made)
