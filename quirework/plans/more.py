"""Queries of writers, cleaners, box tests and renderers, each over a whole table, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import images, records, render, similarity, text
from ..operators import relational
from ..session import shared_dir
from ..sources import files
from . import drafts
from .catalog import query, table


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/quirework/{uuid.uuid4().hex}"


@query("SELECT p_partkey AS word_num, p_size AS \"left\", trim(p_name) AS text, CAST(p_size - 10 AS DOUBLE) AS confidence FROM part WHERE p_size >= 10 AND p_partkey % 5 <> 0")
def word_table(spark, d):
    """Word boxes written as tab-separated text and read back; blank words and negative confidences go."""
    p = table(spark, d, "part")
    zero = F.lit(0)
    word = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.trim("p_name"))
    rows = p.select(zero.alias("level"), zero.alias("page_num"), zero.alias("block_num"), zero.alias("par_num"), zero.alias("line_num"), F.col("p_partkey").cast("int").alias("word_num"), F.col("p_size").alias("left"), zero.alias("top"), zero.alias("width"), zero.alias("height"), (F.col("p_size") - 10).cast("string").alias("conf"), word.alias("text"))
    path = scratch(spark)
    rows.write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.words(spark, path).select(F.col("word_num").cast("long").alias("word_num"), "left", "text", "confidence")


@query("""SELECT CAST(doc_id AS VARCHAR) AS document, CAST(n AS INTEGER) AS page_number, line AS ocr_text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id % 3 <> 0)""")
def imported_pages(spark, d):
    """Documents written as nested JSON page sets, a file each row, and read back flat; missing ones go."""
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("page_number"), line.alias("ocr_text")))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 3 == 0).alias("missing"), parts.alias("pages"))
    path = scratch(spark)
    docs.write.json(path)
    wide = spark.read.schema(files.IMPORTED).json(path)
    return files.flat_pages(wide).select("document", "page_number", "ocr_text")


@query("""SELECT 'INSERT INTO parts (p_partkey, p_name, tags) VALUES (' || CAST(p_partkey AS VARCHAR) || ', ''' || replace(p_name || chr(39) || 's', chr(39), chr(39) || chr(39)) || ''', ARRAY[''' || p_brand || ''', ''x''])' || ';' AS statement FROM part""")
def insert_statements(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("'s")).alias("p_name"), F.array("p_brand", F.lit("x")).alias("tags"))
    return files.insert_script(p, "parts")


@query("SELECT event_id, user_id FROM events WHERE NOT coalesce(props ILIKE '%7%', false)")
def delete_by_pattern(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "props")
    return relational.delete_where(e, F.ilike("props", F.lit("%7%"))).drop("props")


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), s AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id, event_type FROM t UNION ALL SELECT user_id, event_type FROM s WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM t)""")
def insert_or_ignore(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    pairs = lambda x: x.select("user_id", "event_type").distinct()
    return relational.insert_missing(pairs(e.filter("event_id % 2 = 0")), pairs(e), ["user_id", "event_type"])


@query("SELECT p_partkey, regexp_replace(translate(upper(p_name || p_brand), 'IO', '10'), '[^A-Z0-9]+', '', 'g') AS folded, greatest(-999.99, least(999.99, round(p_retailprice, 2))) AS price FROM part")
def folded_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", similarity.decoder_fold(F.concat("p_name", "p_brand")).alias("folded"), text.clamp("p_retailprice").alias("price"))


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.]\\s+', '.' || chr(10), 'g'), '[\\n\\r]+'), lambda s: trim(s)), lambda s: s <> '')) AS n FROM documents""")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences("text")).cast("long").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[.][^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS stem FROM pages")
def safe_stems(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_stem("url").alias("stem"))


_CODE = "'AB-' || CASE WHEN p_partkey % 3 = 0 THEN 'K' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR(9)) END"


@query(f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part)
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(code, '-([0-9]+)$', 1), '') AS INTEGER) AS suffix,
CASE WHEN regexp_matches(code, '^[A-Z]{{2,10}}-[A-Z]?[0-9]+$') THEN regexp_extract(code, '^([A-Z]{{2,10}}-[A-Z]?)([0-9]+)$', 1) || CAST(CAST(regexp_extract(code, '^([A-Z]{{2,10}}-[A-Z]?)([0-9]+)$', 2) AS BIGINT) + 1 AS VARCHAR) ELSE '' END AS following FROM c""")
def code_arithmetic(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    return c.select("p_partkey", text.numeric_suffix("code").alias("suffix"), text.next_code("code").alias("following"))


@query("""SELECT p_partkey, coalesce(p_brand || ' ', '') || p_type || ' {"size":' || CAST(p_size AS VARCHAR) || '}' AS blob FROM part""")
def system_blob(spark, d):
    return table(spark, d, "part").select("p_partkey", records.search_blob(F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type"), F.to_json(F.struct(F.col("p_size").alias("size")))).alias("blob"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) WHEN turn % 3 = 1 AND trim(text || chr(10) || role) <> '' THEN trim(text || chr(10) || role) END AS said FROM conversations""")
def response_texts(spark, d):
    c = table(spark, d, "conversations")
    part = lambda t: F.struct(F.lit("output_text").alias("type"), t.alias("text"))
    parts = F.to_json(F.struct(F.array(F.struct(F.array(part(F.col("text")), F.struct(F.lit("other").alias("type"), F.lit("z").alias("text")), part(F.col("role"))).alias("content"))).alias("output")))
    body = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("output_text")))).when(F.col("turn") % 3 == 1, parts).otherwise(F.lit("{}"))
    return c.select("conv_id", "turn", records.response_text(body).alias("said"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 900 AS x, l_suppkey % 700 AS y, CAST(l_quantity AS INTEGER) * 10 AS w, (l_orderkey % 60) * 10 AS h FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, greatest(0, x - 24) AS x1, greatest(0, y - 24) AS y1, least(1000, x + w + 24) AS x2, least(800, y + h + 24) AS y2, w * h > 4500 AND w * h < 1000 * 800 * 0.35 AND w > 80 AND h > 55 AS plausible FROM b""")
def page_boxes(spark, d):
    li = table(spark, d, "lineitem")
    x, y = F.col("l_partkey") % 900, F.col("l_suppkey") % 700
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity").cast("int") * 10).alias("x2"), (y + F.col("l_orderkey") % 60 * 10).alias("y2"))
    grown = images.expand_box(box, F.lit(1000).cast("long"), F.lit(800).cast("long"), 24)
    return li.select("l_orderkey", "l_partkey", "l_linenumber", grown.alias("g"), images.plausible_box(box, F.lit(1000), F.lit(800)).alias("plausible")).select("l_orderkey", "l_partkey", "l_linenumber", "g.*", "plausible")


@query("""SELECT p_partkey, CASE WHEN concat(a, b) = '' THEN '' ELSE '<table>' || a || b || '</table>' END AS html FROM (SELECT p_partkey,
CASE WHEN p_size % 2 = 0 THEN '<tr><th>Size</th><td>' || CAST(p_size AS VARCHAR) || '</td></tr>' ELSE '' END AS a, CASE WHEN p_partkey % 3 = 0 THEN '<tr><th>Brand</th><td>' || p_brand || '</td></tr>' ELSE '' END AS b FROM part)""")
def truthy_values(spark, d):
    """Values that stand for nothing are left out."""
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("Check source"))
    brand = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit(" - "))
    entries = F.array(F.struct(F.lit("Size").alias("key"), size.alias("value")), F.struct(F.lit("Brand").alias("key"), brand.alias("value")))
    return table(spark, d, "part").select("p_partkey", render.key_value_table(entries).alias("html"))


@query("""SELECT o_orderkey AS code FROM orders WHERE o_totalprice / 500000.0 >= 0.3 AND o_custkey % 20 > 0 AND o_custkey % 20 + o_orderkey % 15 >= o_custkey % 20 AND o_orderkey % 15 + 1 <= 12
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def eligible_sections(spark, d):
    """Sure enough, of a known span of at most twelve pages, and of a wanted code."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("code"), (F.col("o_totalprice") / 500000.0).alias("confidence"), (F.col("o_custkey") % 20).alias("page_start"), (F.col("o_custkey") % 20 + F.col("o_orderkey") % 15).alias("page_end"))
    wanted = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("code"))
    return drafts.eligible(o, 0.3, wanted).select(F.col("o_orderkey").alias("code"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS published, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 2 = 0) AS awaiting, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 2 = 1) AS rejected,
count(*) FILTER (o_orderstatus = 'P') AS review, count(*) FILTER (o_orderkey % 4 = 0) AS waiting FROM orders""")
def publication_tallies(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "needs_review").when(F.col("o_custkey") % 2 == 0, "awaiting_verification").otherwise("rejected")
    found = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("Awaiting Verification of source"))).otherwise(F.array(F.lit("other")))
    return drafts.tallies(table(spark, d, "orders").select(s.alias("status"), found.alias("issues")))


@query("""SELECT p_partkey, k AS position, CASE WHEN p_size % 8 + 1 = k OR p_partkey % 8 + 1 = k THEN 'x' ELSE '-' END AS mark FROM part, range(1, 9) t(k)""")
def position_cells(spark, d):
    cells = render.position_map(F.array((F.col("p_size") % 8 + 1).cast("int"), (F.col("p_partkey") % 8 + 1).cast("int")))
    marks = F.regexp_extract_all(cells, F.lit("<td>(.)</td>"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.posexplode(marks).alias("i", "mark")).select("p_partkey", (F.col("i") + 1).cast("long").alias("position"), "mark")
