"""Queries of the asset scan and of refreshed drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets
from ..session import written
from . import candidates, refresh
from .catalog import _line_pages, query, table

_PAGES_SQL = """SELECT doc_id AS document, n AS page_number, line AS t, CASE WHEN (n - 1) % 7 = 0 THEN 'AB-' || CAST((n - 1) // 7 + 1 AS VARCHAR) END AS code
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""
BUDGET = 40


@query(f"""WITH p AS ({_PAGES_SQL}), c AS (SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY document ORDER BY page_number) AS system_code FROM p),
b AS (SELECT document, page_number, system_code, k AS box, 200 + 40 * k + length(t) AS width, 60 + 30 * k + length(t) // 4 AS height FROM c, range(0, 4) r(k) WHERE contains(t, 'th') AND regexp_matches(system_code, '^[A-Z]{{2,10}}-[A-Z0-9]{{1,4}}$')),
i AS (SELECT *, substring(sha1(CAST(document AS VARCHAR) || ':' || CAST(page_number AS VARCHAR) || ':' || CAST(box AS VARCHAR)), 1, 16) AS asset_id FROM b WHERE width >= 280 AND height >= 100),
k AS (SELECT *, asset_id < 'c' AS known, asset_id < '6' AS drawn FROM i),
w AS (SELECT * FROM (SELECT *, count(*) FILTER (drawn) OVER (PARTITION BY document, page_number ORDER BY box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) WHERE before < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY document, page_number, box) AS place FROM w)
SELECT document, CAST(page_number AS INTEGER) AS page_number, CAST(box AS INTEGER) AS box, system_code, asset_id, CASE WHEN drawn THEN 'ready' WHEN known THEN 'none' WHEN place <= {BUDGET} THEN 'request' ELSE 'waiting' END AS status FROM r""")
def asset_scan(spark, d):
    """Lines of documents as pages with four boxes each, by the length of the line; half of the assets are in the cache."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("n", "t")).withColumn("page_number", F.col("n") + 1)
    own = F.when(F.col("n") % 7 == 0, F.concat(F.lit("AB-"), (F.floor(F.col("n") / 7) + 1).cast("string")))
    box = pages.select("document", "page_number", F.char_length("t").alias("size"), F.explode(F.array(*map(F.lit, range(4)))).alias("box"))
    boxes = box.select("document", "page_number", "box", (200 + 40 * F.col("box") + F.col("size")).alias("width"), (60 + 30 * F.col("box") + F.floor(F.col("size") / 4)).alias("height"))
    keys = boxes.select(assets.asset_id(F.col("document"), F.col("page_number"), F.col("box")).alias("asset_id"))
    cache = keys.filter("asset_id < 'c'").select("asset_id", F.when(F.col("asset_id") < "6", F.lit("{}")).alias("diagram"))
    return assets.scan(pages, boxes, cache, F.contains("t", F.lit("th")), own, BUDGET).select("document", "page_number", "box", "system_code", "asset_id", "status")


@query("""WITH e AS (SELECT 'EV-' || CAST(vec_id AS VARCHAR) AS code, embedding, embedding[64] >= 0 AS verified FROM embeddings)
SELECT code AS system_code, CAST(k AS INTEGER) AS place, '{"title":"' || code || '","marks":' || CAST(len(list_filter(embedding[k * 16 + 1 : k * 16 + 16], lambda v: v >= 0.1)) AS VARCHAR) || '}' AS diagram,
substring(sha1('report:' || code || ':' || CAST(k AS VARCHAR) || ':' || '{"title":"' || code || '","marks":' || CAST(len(list_filter(embedding[k * 16 + 1 : k * 16 + 16], lambda v: v >= 0.1)) AS VARCHAR) || '}'), 1, 16) AS asset_id
FROM e, range(0, 3) r(k) WHERE verified AND regexp_matches(code, '^[A-Z]{2,10}-[A-Z0-9]{1,4}$')""")
def report_assets(spark, d):
    """The first three of four diagrams of each verified report."""
    e = table(spark, d, "embeddings").withColumn("code", F.concat(F.lit("EV-"), F.col("vec_id").cast("string")))
    marks = lambda k: F.size(F.filter(F.slice("embedding", 16 * k + 1, 16), lambda v: v >= 0.1))
    diagrams = F.array(*[F.struct(F.col("code").alias("title"), marks(k).alias("marks")) for k in range(4)])
    reports = e.select("code", (F.element_at("embedding", 64) >= 0).alias("verified"), F.array().cast("array<string>").alias("issues"), diagrams.alias("diagrams"))
    return assets.from_reports(reports)


@query()
def refreshed_drafts(spark, d):
    """Drafts after an edit of the French documents: which were made anew, which stayed."""
    vocabulary, makes = {"Ford": ["Focus"]}, {"AB": "Ford"}
    pages = _line_pages(spark, d)
    french = table(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("document"))
    before = pages.join(french.withColumn("edited", F.lit(True)), "document", "left").withColumn("text", F.when(F.col("edited") & (F.col("page_number") == 3), F.concat("text", F.lit(" older"))).otherwise(F.col("text"))).drop("edited")
    earlier = written(refresh.refresh(*candidates.build(before, vocabulary, makes)), "drafts")  # both uses below read it
    now = refresh.refresh(*candidates.build(pages, vocabulary, makes), earlier)
    return now.select("code", "source_document", "page_start", "source_key", "rebuilt", F.to_json("draft").alias("draft"))
