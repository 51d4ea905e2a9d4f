"""Which diagrams of scanned pages are published, requested from a reader, or wait.

What a reader makes of a picture enters as a table: an asset's id and its diagram, or null where
the picture holds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gates import CODE_SHAPE
from .relational import budgeted_by_key, carry_forward

# The least picture, the most published of a page and of a report.
LEAST_WIDTH, LEAST_HEIGHT = 280, 100
MOST_OF_PAGE, MOST_OF_REPORT = 2, 3


def asset_id(document: Column, page: Column, box: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", document.cast("string"), page.cast("string"), box.cast("string"))), 1, 16)


def scan(pages: DataFrame, boxes: DataFrame, cache: DataFrame, candidate: Column, own_code: Column, budget: int, allowed: DataFrame | None = None) -> DataFrame:
    """Boxes of candidate pages with system_code, asset_id, diagram and status.

    ``pages``: document, page_number and what ``candidate`` and ``own_code`` (null: none on the
    page) read; a page without a code has that of the last page of its document with one.
    ``boxes``: document, page_number, box (its number on the page), width, height.  ``cache``:
    asset_id, diagram.  ``allowed``: code.  Status: 'ready' with a diagram in the cache, 'none'
    where the cache says that there is none, 'request' for the first ``budget`` of the rest by
    document, page and box, else 'waiting'.  Boxes behind the second ready one of a page, small
    ones and codes without a code's shape go.
    """
    coded = carry_forward(pages, ["document"], ["page_number"], own_code, "system_code")
    coded = coded.filter(candidate & F.rlike(F.coalesce("system_code", F.lit("")), F.lit(CODE_SHAPE))).select("document", "page_number", "system_code")
    if allowed is not None:
        coded = coded.join(allowed.select(F.col("code").alias("system_code")).distinct(), "system_code", "left_semi")
    large = boxes.filter((F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT)).select("document", "page_number", "box", "width", "height")
    found = coded.join(large, ["document", "page_number"]).withColumn("asset_id", asset_id(F.col("document"), F.col("page_number"), F.col("box")))
    known = cache.groupBy("asset_id").agg(F.max("diagram").alias("diagram"), F.lit(True).alias("_known"))
    found = found.join(known, "asset_id", "left")
    before = Window.partitionBy("document", "page_number").orderBy("box").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_ready", F.coalesce(F.count("diagram").over(before), F.lit(0))).filter(F.col("_ready") < MOST_OF_PAGE).drop("_ready")
    unknown = F.col("_known").isNull()
    found = budgeted_by_key(found, "asset_id", unknown, ["document", "page_number", "box"], budget)
    status = F.when(F.col("diagram").isNotNull(), "ready").when(~unknown, "none").when(F.col("status") == "run", "request").otherwise("waiting")
    return found.withColumn("status", status).drop("_known")


def from_reports(drafts: DataFrame, diagrams: str = "diagrams") -> DataFrame:
    """The first diagrams of verified reports without issues: system_code, place, asset_id, diagram (JSON)."""
    fit = drafts.filter(F.col("verified") & (F.coalesce(F.size("issues"), F.lit(0)) <= 0) & F.rlike(F.coalesce("code", F.lit("")), F.lit(CODE_SHAPE)))
    rows = fit.select(F.col("code").alias("system_code"), F.posexplode(F.slice(diagrams, 1, MOST_OF_REPORT)).alias("place", "_diagram")).withColumn("diagram", F.to_json("_diagram")).filter("_diagram is not null")
    key = F.concat_ws(":", F.lit("report"), "system_code", F.col("place").cast("string"), "diagram")
    return rows.select("system_code", "place", F.substring(F.sha1(key), 1, 16).alias("asset_id"), "diagram")
