"""Registered queries of the reference's own operators, each over whole tables, with oracle SQL.

The reference's domain tables are not in the test data, so every operator runs on an analogue:
applications come from lineitem and part, pages from documents, grids from embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, records, render, similarity, text, years
from ..operators import gates, geometry, lookup, relational, search, sections
from ..streaming import incremental
from . import candidates, drafts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    joined = li.join(part, li["l_partkey"] == part["p_partkey"])
    return joined.groupBy("make", "model", F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("code")).agg(F.min("y").alias("year_from"), F.max("y").alias("year_to"))


def requests(apps: DataFrame) -> DataFrame:
    return apps.select("make", "model").distinct().withColumn("year", F.explode(F.sequence(F.lit(1994), F.lit(2003))))


APPL = """appl AS (SELECT p_brand AS make, p_type AS model, 'S-' || CAST(l_suppkey AS VARCHAR) AS code,
  CAST(min(year(l_shipdate)) AS INTEGER) AS year_from, CAST(max(year(l_shipdate)) AS INTEGER) AS year_to
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
req AS (SELECT make, model, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT make, model FROM appl), range(1994, 2004) t(y)),
cand AS (SELECT req.make, req.model, year, year_from, year_to, code, (year BETWEEN year_from AND year_to) AS covered
  FROM req JOIN appl ON lower(req.make) = lower(appl.make) AND lower(req.model) = lower(appl.model))"""
NEAR = "CASE WHEN covered THEN 0 ELSE 1 END, abs(year_from - year), year_to DESC"

# -- lookups ---------------------------------------------------------------------------------


@query(f"""WITH {APPL}, r AS (SELECT *, row_number() OVER (PARTITION BY make, model, year ORDER BY year_to - year_from, year_from, year_to, code) AS k FROM cand WHERE covered)
SELECT make, model, year, year_from, year_to, code FROM r WHERE k = 1""")
def lookup_exact(spark, d):
    apps = applications(spark, d)
    return lookup.exact(requests(apps), apps)


@query(f"""WITH {APPL}, r AS (SELECT *, row_number() OVER (PARTITION BY make, model, year ORDER BY {NEAR}, year_from, year_to, code) AS k FROM cand)
SELECT make, model, year, year_from, year_to, code, covered FROM r WHERE k = 1""")
def lookup_nearest(spark, d):
    apps = applications(spark, d)
    return lookup.nearest(requests(apps), apps)


@query(f"""WITH {APPL}, pub AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_acctbal > 0),
m AS (SELECT cand.*, cand.code IN (SELECT code FROM pub) AS published,
  row_number() OVER (PARTITION BY make, model, year ORDER BY CASE WHEN covered THEN 0 ELSE 1 END, year_to - year_from, year_from, year_to, code) AS er FROM cand),
t AS (SELECT *, CASE WHEN covered AND er = 1 AND published THEN 1 WHEN published THEN 2 WHEN covered AND er = 1 THEN 3 ELSE 6 END AS tier FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY make, model, year ORDER BY tier, {NEAR}, year_from, year_to, code) AS k FROM t)
SELECT make, model, year, year_from, year_to, code, CAST(tier AS INTEGER) AS tier FROM r WHERE k = 1""")
def lookup_tiered(spark, d):
    apps = applications(spark, d)
    published = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"))
    return lookup.tiered(requests(apps), apps, published)


@query(f"""WITH {APPL}, pub AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_acctbal > 0),
w AS (SELECT *, CASE WHEN CAST(substring(code, 3) AS INTEGER) % 3 <> 0 THEN model || ' ?' ELSE model END AS raw, CASE WHEN CAST(substring(code, 3) AS INTEGER) % 5 <> 0 THEN model ELSE '' END AS display FROM appl),
b AS (SELECT req.make, req.model, req.year, w.year_from, w.year_to, w.code, true AS own FROM req JOIN w ON lower(req.make) = lower(w.make) AND lower(req.model) = lower(w.raw)
  UNION ALL SELECT req.make, req.model, req.year, w.year_from, w.year_to, w.code, false FROM req JOIN w ON lower(req.make) = lower(w.make) AND lower(req.model) = lower(w.display) WHERE w.display <> ''),
c AS (SELECT *, year BETWEEN year_from AND year_to AS covered, code IN (SELECT code FROM pub) AS published FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY make, model, year, own ORDER BY CASE WHEN covered THEN 0 ELSE 1 END, year_to - year_from, year_from, year_to, code) AS er,
  row_number() OVER (PARTITION BY make, model, year, own ORDER BY {NEAR}, year_from, year_to, code) AS nr FROM c),
t AS (SELECT *, CASE WHEN own THEN CASE WHEN covered AND er = 1 AND published THEN 1 WHEN published THEN 2 WHEN covered AND er = 1 THEN 3 ELSE 7 END ELSE CASE WHEN nr = 1 AND published THEN 4 WHEN published THEN 5 WHEN nr = 1 THEN 6 END END AS tier FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY make, model, year ORDER BY tier, {NEAR}, year_from, year_to, code) AS k FROM t WHERE tier IS NOT NULL)
SELECT make, model, year, year_from, year_to, code, CAST(least(tier, 6) AS INTEGER) AS tier FROM r WHERE k = 1""")
def lookup_tiered_display(spark, d):
    """Damaged raw names beside display names: all six tiers have rows."""
    apps = applications(spark, d)
    number = F.substring_index("code", "-", -1).cast("int")
    named = apps.withColumn("display", F.when(number % 5 != 0, F.col("model")).otherwise("")).withColumn("model", F.when(number % 3 != 0, F.concat("model", F.lit(" ?"))).otherwise(F.col("model")))
    published = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"))
    return lookup.tiered(requests(apps), named, published, "display")


@query("""WITH e AS (SELECT user_id, event_type, [CAST(event_id % 5 AS INTEGER), CAST(event_id % 2 AS INTEGER)] AS pages, event_id, CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'approved' END AS status FROM events)
SELECT user_id, event_type, pages, max(event_id) AS event_id, CASE WHEN bool_or(event_id % 3 <> 0) THEN arg_max(status, event_id) FILTER (event_id % 3 <> 0) ELSE arg_max(status, event_id) END AS status FROM e GROUP BY user_id, event_type, pages""")
def upsert_keeps_status(spark, d):
    """Upsert on a key with an array; the status of a row that is there stays."""
    e = table(spark, d, "events").select("user_id", "event_type", F.array((F.col("event_id") % 5).cast("int"), (F.col("event_id") % 2).cast("int")).alias("pages"), "event_id", F.when(F.col("event_id") % 4 == 0, "pending").otherwise("approved").alias("status"))
    old, new = e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0")
    keys = ["user_id", "event_type", "pages"]
    return relational.upsert(relational.upsert(old.limit(0), old, keys, "event_id"), new, keys, "event_id", kept=["status"])


@query(f"""WITH {APPL}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year_from, year_to DESC, make, model) AS k FROM appl)
SELECT make, model, code, year_from, year_to FROM r WHERE k = 1""")
def representative_per_code(spark, d):
    return lookup.representative(applications(spark, d))


@query("SELECT event_id, user_id, event_type FROM events WHERE (event_type IS NULL OR event_type = 'purchase')")
def optional_param_filter(spark, d):
    return lookup.optional_filter(table(spark, d, "events").select("event_id", "user_id", "event_type"), event_type="purchase", user_id=None)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def case_insensitive_eq(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey", "c_mktsegment")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS a, least(year(o_orderdate) + o_orderkey % 4, 2001) AS b FROM orders)
SELECT o_orderkey, CAST(y AS BIGINT) AS y FROM o, range(1990, 2010) t(y) WHERE y BETWEEN a AND b""")
def interval_expand(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("a"), F.least(F.year("o_orderdate") + F.pmod("o_orderkey", F.lit(4)), F.lit(2001)).cast("int").alias("b"))
    points = spark.range(1990, 2010).select(F.col("id").alias("y"))
    return lookup.interval_members(o, "a", "b", points, "y").select("o_orderkey", "y")


@query("""SELECT doc_id, CASE WHEN r >= 0.22 AND r < 0.48 THEN 'model' WHEN r >= 0.48 AND r < 0.62 THEN 'years' WHEN r >= 0.62 AND r < 0.73 THEN 'type'
 WHEN r >= 0.73 AND r < 0.86 THEN 'section' WHEN r >= 0.86 AND r < 0.98 THEN 'page' END AS col
FROM (SELECT doc_id, (n_chars % 1000) / 1000.0 AS r FROM documents)""")
def theta_column_assign(spark, d):
    return table(spark, d, "documents").select("doc_id", lookup.column_of(F.col("n_chars") % 1000 / 1000.0, geometry.TOC_COLUMNS).alias("col"))


@query("SELECT d.doc_id, lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_published(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1")
    return docs.join(labels, "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT d.doc_id, lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey <> 1")
def fk_set_null(spark, d):
    nations = table(spark, d, "nation").filter("n_regionkey <> 1")
    kept = relational.set_null_where_missing(table(spark, d, "customer"), "c_nationkey", nations, "n_nationkey")
    return kept.join(nations, kept["c_nationkey"] == nations["n_nationkey"], "left").select("c_custkey", "c_name", "n_name")


# -- aggregates ------------------------------------------------------------------------------


@query("""SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'documents_en', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'labels_toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'orders_open', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'suppliers_used', count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey <> 1 UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events""")
def dashboard_counts(spark, d):
    t = lambda n: table(spark, d, n)
    plain = relational.counts(
        {
            "documents": t("documents"),
            "documents_en": t("documents").filter("lang = 'en'"),
            "labels_toxic": t("labels").filter("toxic = 1"),
            "pages": t("pages"),
            "orders_open": t("orders").filter("o_orderstatus = 'O'"),
            "customers": t("customer"),
            "events": t("events"),
        }
    )
    used = t("lineitem").filter("l_suppkey <> 1").agg(F.count_distinct("l_suppkey").alias("n")).select(F.lit("suppliers_used").alias("metric"), "n")
    return plain.unionByName(used)


@query("SELECT source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY source")
def freq_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen"))


@query("SELECT split_part(url, ':', 1) AS prefix, count(*) AS n FROM pages GROUP BY 1")
def freq_by_prefix(spark, d):
    return table(spark, d, "pages").groupBy(F.substring_index("url", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source, lang")
def count_by_two_keys(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents")
def count_by_doc_line(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS low, count(*) FILTER (WHERE toxic = 1) AS suspicious
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def conditional_counts(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("suspicious"))


@query("""SELECT d.doc_id, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE coalesce(quality, 0) = 0 OR length(text) < 120""")
def weak_documents(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
    return j.filter((F.col("quality") == 0) | (F.char_length("text") < 120)).select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH c AS (SELECT source, doc_id, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS issues FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY issues, doc_id) AS k FROM c) SELECT source, doc_id, issues FROM r WHERE k = 1""")
def argmin_issues(spark, d):
    c = table(spark, d, "documents").select("source", "doc_id", text.count_matches("text", "[0-9]").cast("long").alias("issues"))
    return gates.best_prior(c, "source", "issues", "doc_id")


@query("""SELECT p_partkey, CAST(coalesce(n, 0) * 3 + coalesce(s, 0) * 2 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS score FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def record_completeness_score(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("s"))
    p = table(spark, d, "part")
    j = p.join(li, p["p_partkey"] == li["l_partkey"], "left")
    return j.select("p_partkey", gates.record_score([(F.col("n"), 3), (F.col("s"), 2), ((F.col("p_size") > 25).cast("int"), 1)]).alias("score"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_rollup(spark, d):
    return relational.roll_up_text(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))), ',') AS names FROM documents""")
def sorted_distinct_values(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.sorted_values("text", "[A-Z][a-z]+"), ",").alias("names"))


@query("SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS types FROM part GROUP BY p_brand")
def group_label(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("""SELECT user_id, bool_and(value >= 0) AS all_ok, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id""")
def tri_state(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("value") >= 0).alias("all_ok"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("SELECT d.doc_id, coalesce(max(l.quality), 0) AS best FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def max_with_default(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.max("quality"), F.lit(0)).alias("best"))


# -- windows ---------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations""")
def carry_forward(spark, d):
    c = table(spark, d, "conversations")
    return relational.carry_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "last_user").select("conv_id", "turn", "last_user")


@query("""SELECT conv_id, turn, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def lead_lag_turns(spark, d):
    return relational.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "prev_role", "next_role")


@query("""WITH s AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT s.conv_id, s.turn, coalesce(nx - 1, last) AS segment_end FROM s JOIN m ON s.conv_id = m.conv_id""")
def segment_end(spark, d):
    return relational.segment_ends(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "segment_end")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE k = 1""")
def first_per_key(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return relational.first_per_key(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type, event_id FROM r WHERE k = 1""")
def last_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return relational.last_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS finished_later FROM events""")
def later_finished(spark, d):
    return relational.later_exists(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "finished_later").select("event_id", "finished_later")


@query("""WITH w AS (SELECT d.doc_id, l.doc_id IS NULL AS miss, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT doc_id FROM w WHERE miss ORDER BY n_chars DESC, doc_id LIMIT 25)
SELECT doc_id, CASE WHEN NOT miss THEN 'cached' WHEN doc_id IN (SELECT doc_id FROM p) THEN 'run' ELSE 'waiting' END AS status FROM w""")
def budgeted_queue(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    w = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return relational.budgeted_by_key(w, "doc_id", F.col("known").isNull(), [F.desc("n_chars"), "doc_id"], 25).select("doc_id", "status")


@query("""WITH s AS (SELECT vec_id, CAST(i AS INTEGER) AS i, embedding[i] AS a, embedding[i+1] AS b, embedding[i+2] AS c, embedding[i+3] AS e FROM embeddings, range(1, 62) t(i)),
f AS (SELECT vec_id, min(i) AS i FROM s WHERE a > b AND b > c AND c > e GROUP BY vec_id)
SELECT v.vec_id, f.i AS start_at FROM embeddings v LEFT JOIN f ON v.vec_id = f.vec_id""")
def monotone_run(spark, d):
    e = table(spark, d, "embeddings").withColumn("run", relational.monotone_run(F.col("embedding"), 4))
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(61)), lambda i: F.slice("embedding", i, F.lit(4)) == F.col("run")))
    return e.select("vec_id", F.when(F.col("run").isNotNull(), at).alias("start_at"))


@query("""WITH h AS (SELECT vec_id, CAST(i AS INTEGER) AS p FROM embeddings, range(0, 64) t(i) WHERE embedding[i+1] >= 0.05),
n AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY vec_id ORDER BY p) - 1 > 1 THEN 1 ELSE 0 END AS nw FROM h),
b AS (SELECT vec_id, p, sum(nw) OVER (PARTITION BY vec_id ORDER BY p) AS band FROM n)
SELECT vec_id, min(p) AS band_start, max(p) + 1 AS band_end FROM b GROUP BY vec_id, band HAVING max(p) + 1 - min(p) >= 3""")
def density_bands(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return relational.density_bands(cells, ["vec_id"], "p", F.col("v"), 0.05, 3, 1)


# -- sets, order -----------------------------------------------------------------------------


@query("SELECT d.doc_id, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 ORDER BY n_chars DESC NULLS LAST, d.doc_id LIMIT 20")
def topk_usefulness(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")
    return j.orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def set_difference(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").filter("s_acctbal > 8000")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left_anti").select("n_name")


@query("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def bag_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


@query("SELECT DISTINCT p_brand AS make, p_type AS model FROM part")
def distinct_models(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).distinct()


# -- similarity and search -------------------------------------------------------------------

#: A vocabulary of the analogue: part types by brand.
VOCABULARY = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


@query()
def canonicalize(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("part").alias("kind"), F.split("p_type", " ")[0].alias("word"))
    return similarity.canonicalize(p, {"part": VOCABULARY}, "kind", "word").select("p_partkey", "canonical", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS folded FROM customer")
def alnum_fold(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.alnum_fold("c_name").alias("folded"))


@query("""WITH f AS (SELECT doc_id, lower(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS t FROM documents),
s AS (SELECT doc_id, CAST(contains(t, 'the') AS INTEGER) + CAST(contains(t, 'tion') AS INTEGER) + CAST(contains(t, 'einung') AS INTEGER) AS score FROM f)
SELECT doc_id, score FROM s WHERE score >= 2 ORDER BY score DESC, doc_id LIMIT 10""")
def term_presence_search(spark, d):
    return search.term_search(table(spark, d, "documents"), "text", ["the", "tion", "einung"], ["doc_id"]).select("doc_id", "score")


@query("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'tion') AS hit FROM documents),
s AS (SELECT doc_id, text, CASE WHEN hit > 0 THEN greatest(hit - 1 - 90, 0) ELSE 0 END AS st FROM p)
SELECT doc_id, CASE WHEN st > 0 THEN '...' ELSE '' END || replace(substring(text, CAST(st + 1 AS BIGINT), 300), chr(10), ' ') || CASE WHEN st + 300 < length(text) THEN '...' ELSE '' END AS snippet FROM s""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", search.snippet("text", ["tion"]).alias("snippet"))


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part), w AS (SELECT n, unnest(string_split(lower(n), ' ')) AS w FROM n),
g AS (SELECT DISTINCT n, substring('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM w, range(1, 40) t(i) WHERE i <= length(w) + 1),
z AS (SELECT n, count(*) AS c FROM g GROUP BY n), s AS (SELECT x.n AS a, y.n AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.n < y.n GROUP BY 1, 2)
SELECT a, b, round(s.c / CAST(za.c + zb.c - s.c AS DOUBLE), 6) AS similarity FROM s JOIN z za ON za.n = a JOIN z zb ON zb.n = b WHERE s.c / CAST(za.c + zb.c - s.c AS DOUBLE) >= 0.3""")
def trigram_similarity(spark, d):
    return similarity.similar_pairs(table(spark, d, "part"), "p_name").withColumn("similarity", F.round("similarity", 6))


# -- text ------------------------------------------------------------------------------------


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(translate(html, '–—‘’“”', '--' || chr(39) || chr(39) || '""'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM pages""")
def ocr_clean(spark, d):
    return table(spark, d, "pages").select("page_id", text.ocr_clean("html").alias("cleaned"))


QUALITY = """CAST(100 * length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) + 15 * (length({0}) - length(replace({0}, ' ', '')))
 + 1200 * len(regexp_extract_all({0}, '(?i)\\b(?:FCC|MHz|Lishi|AccuReader|Determinator|Remote|Fob|Code Series|SPACING|DEPTHS|PIN|Transponder|Chip|Key|Door|Trunk|Ignition)\\b'))
 - 800 * length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) - 500 * len(regexp_extract_all({0}, '[±¤\\[\\]{{}}]|[A-Za-z][0-9][A-Za-z]')) AS BIGINT)"""


def _quality_sql(column: str) -> str:
    """Words bounded by any letter, also one with an accent."""
    return QUALITY.format(column).replace(f"regexp_extract_all({column}, '(?i)", f"regexp_extract_all(strip_accents({column}), '(?i)")


@query(f"SELECT doc_id, {_quality_sql('t')} AS points FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def text_quality_score(spark, d):
    return table(spark, d, "documents").select("doc_id", text.quality_points("text").alias("points"))


@query(ORACLE_SQL["text_quality_score"])
def text_quality_score_whole(spark, d):
    """The same as the query before, which keeps no more to some rows."""
    return text_quality_score(spark, d)


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT d.doc_id, coalesce(d.text, '') AS a, coalesce(b.text, '') AS b FROM documents d CROSS JOIN n LEFT JOIN benchmark b ON d.doc_id % n.n = b.item_id),
p AS (SELECT *, {_quality_sql('a')} AS pa, {_quality_sql('b')} AS pb FROM b)
SELECT doc_id, CASE WHEN a = b OR (100 * pa >= 85 * pb AND length(a) > 80) THEN 'native' WHEN pb >= pa AND length(b) > 40 THEN 'scan' WHEN a <> '' OR b = '' THEN 'native' ELSE 'scan' END AS chosen FROM p""")
def choose_best_text(spark, d):
    """Every document against an item of the whole benchmark as its other reading."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    j = docs.join(b, F.pmod(docs["doc_id"], F.lit(max(1, b.count()))) == b["item_id"], "left")
    return j.select("doc_id", F.when(text.choose_text("a", "b") == F.coalesce("a", F.lit("")), "native").otherwise("scan").alias("chosen"))


@query(ORACLE_SQL["choose_best_text"])
def choose_best_text_whole(spark, d):
    return choose_best_text(spark, d)


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 30 AS k FROM orders), s AS (SELECT o_orderkey, y, y + k AS e FROM o)
SELECT o_orderkey, CASE WHEN e - y <= 50 AND e <= 2035 THEN CAST(y AS INTEGER) END AS year_from, CASE WHEN e - y <= 50 AND e <= 2035 THEN CAST(e AS INTEGER) END AS year_to FROM s""")
def year_range_parse(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.year("o_orderdate") + F.pmod("o_orderkey", F.lit(30))).alias("e"))
    written = F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(F.pmod("e", F.lit(100)).cast("string"), 2, "0"))
    r = years.strict(written)
    return o.select("o_orderkey", r["year_from"].alias("year_from"), r["year_to"].alias("year_to"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'proximity') THEN 'Proximity' WHEN contains(lower(p_type), 'fobik') THEN 'Fobik' WHEN contains(lower(p_type), 'key') THEN 'Key'
 WHEN contains(lower(p_type), 'remote') THEN 'Remote' WHEN contains(lower(p_type), 'transponder') THEN 'Transponder' ELSE 'Key' END AS kind FROM part""")
def type_detection(spark, d):
    return table(spark, d, "part").select("p_partkey", text.detect_type("p_type").alias("kind"))


@query("""SELECT p_partkey, CAST(greatest(35, least(90, 76 + CASE WHEN p_brand <> 'Brand#11' THEN 8 ELSE 0 END - CASE WHEN regexp_matches(p_type, '[0-9]') THEN 6 ELSE 0 END - CASE WHEN length(p_type) > 24 THEN 12 ELSE 0 END)) AS INTEGER) AS points FROM part""")
def confidence_model(spark, d):
    return table(spark, d, "part").select("p_partkey", text.link_points("p_brand", "p_type", F.lit("Brand#11")).cast("int").alias("points"))


@query("""SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._]+)@', 1), '') AS account, nullif(regexp_extract(text, 'Version ([0-9.]+[0-9])', 1), '') AS version,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{3,}'))), ',') AS numbers FROM documents""")
def regex_fields(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.extract("text", "([A-Za-z0-9._]+)@").alias("account"), text.extract("text", "Version ([0-9.]+[0-9])").alias("version"), F.array_join(text.sorted_values("text", "[0-9]{3,}"), ",").alias("numbers")
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
SELECT doc_id, CAST(no AS INTEGER) AS line_no, CASE WHEN regexp_matches(line, '^[A-Z]') AND length(line) <= 40 THEN 'heading' ELSE 'body' END AS kind FROM l WHERE line <> ''""")
def toc_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter("line <> ''")
    kind = F.when(F.rlike("line", F.lit("^[A-Z]")) & (F.char_length("line") <= 40), "heading").otherwise("body")
    return lines.select("doc_id", (F.col("p") + 1).alias("line_no"), kind.alias("kind"))


@query("""SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[^\\x00-\\x7F]') OR (length(t) > 24 AND 100 * length(regexp_replace(t, '[^A-Za-z]', '', 'g')) < 42 * length(t)) OR regexp_matches(t, '(?i)worthless') THEN false ELSE true END AS fit
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def public_text_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", (text.public_text("text", "worthless") != "").alias("fit"))


MEANINGFUL = """length(line) BETWEEN 28 AND 520 AND length(line) - length(replace(line, ' ', '')) >= 3 AND NOT regexp_matches(line, '[^\\x00-\\x7F]')
 AND 100 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 42 * length(line)"""


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE {MEANINGFUL} GROUP BY doc_id")
def meaningful_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(text.meaningful_line("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER ({MEANINGFUL}) AS n FROM l GROUP BY doc_id")
def meaningful_lines_whole(spark, d):
    """Documents without such a line too."""
    lines = table(spark, d, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.coalesce(text.meaningful_line("line"), F.lit(False))).alias("n"))


#: Keyword rules of the analogue.
KEYWORDS = (("license", "licensed"), ("@", "has an address"), ("the", "english"), ("und", "german"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'licensed' END, CASE WHEN contains(text, '@') THEN 'has an address' END,
 CASE WHEN contains(lower(text), 'the') THEN 'english' END, CASE WHEN contains(lower(text), 'und') THEN 'german' END], lambda x: x IS NOT NULL), ',') AS notes FROM documents""")
def keyword_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.rule_texts("text", KEYWORDS), ",").alias("notes"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '(?i)license', 'permit', 'g'), '(?i)version', 'release', 'g') AS rewritten FROM documents""")
def rewrite_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rewrite("text", [("license", "permit"), ("version", "release")]).alias("rewritten"))


@query(ORACLE_SQL["rewrite_rules"])
def rewrite_rules_whole(spark, d):
    return rewrite_rules(spark, d)


@query("SELECT doc_id, sha256(text) AS key, substring(sha1(text), 1, 16) AS id FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.substring(F.sha1("text"), 1, 16).alias("id"))


@query("SELECT p_partkey, length(p_name) > 18 AND regexp_matches(p_name, '[0-9]') OR length(p_name) > 45 OR length(p_name) < 2 AS suspicious FROM part")
def suspicious_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", text.suspicious_name("p_name").alias("suspicious"))


# -- JSON and records ------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _nested(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "O", F.lit(" ")).otherwise(F.lit("done ")).alias("note")))).alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.trim("o_orderpriority").alias("priority"), F.lit("").alias("blank")).alias("head"))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", F.struct("head", "lines").alias("r"))


@query("""WITH l AS (SELECT l_orderkey, string_agg('{"flag":"' || l_returnflag || '"' || CASE WHEN l_linestatus = 'O' THEN '' ELSE ',"note":"done"' END || '}', ',' ORDER BY l_returnflag, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'done ' END) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, '{"head":{"priority":"' || trim(o_orderpriority) || '"},"lines":[' || lines || ']}' AS pruned FROM orders JOIN l ON o_orderkey = l_orderkey""")
def recursive_prune(spark, d):
    n = _nested(spark, d)
    return n.select("o_orderkey", F.to_json(records.prune(F.col("r"), n.schema["r"].dataType)).alias("pruned"))


@query("""WITH l AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'done ' END) - 1 AS i FROM lineitem)
SELECT o_orderkey, 'report.lines[' || CAST(i AS VARCHAR) || '].note: done ' AS issue FROM orders JOIN l ON o_orderkey = l_orderkey WHERE l_linestatus <> 'O'
UNION ALL SELECT o_orderkey, 'report.head.priority: ' || trim(o_orderpriority) FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def issue_paths(spark, d):
    n = _nested(spark, d)
    return n.select("o_orderkey", F.explode(records.issues(F.col("r"), n.schema["r"].dataType, ["^done", "urgent"])).alias("issue"))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, array_to_string(list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS suppliers FROM r WHERE k = 1 GROUP BY l_orderkey""")
def keyed_array_dedupe(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_suppkey").alias("s")))).alias("a"))
    return rows.select("l_orderkey", F.array_join(F.transform(records.dedupe_array(F.col("a"), lambda v: v["s"].cast("string")), lambda v: v["s"].cast("string")), ",").alias("suppliers"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Brand#X' ELSE p_brand END AS brand, p_size, CASE WHEN p_size > 25 THEN 'large' ELSE p_type END AS type FROM part")
def deep_merge(spark, d):
    p = table(spark, d, "part")
    base = F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("spec"))
    over = F.when(F.col("p_size") > 25, F.struct(F.lit("Brand#X").alias("brand"), F.struct(F.lit(None).cast("int").alias("size"), F.lit("large").alias("type")).alias("spec")))
    w = p.select("p_partkey", base.alias("b"), over.alias("o"))
    m = w.select("p_partkey", records.merge(F.col("b"), F.col("o"), w.schema["b"].dataType).alias("m"))
    return m.select("p_partkey", "m.brand", F.col("m.spec.size").alias("p_size"), F.col("m.spec.type").alias("type"))


@query("""SELECT doc_id, CASE WHEN contains(upper(text), 'LICENSE') AND contains(upper(text), 'APACHE') THEN 'apache' WHEN contains(upper(text), 'LICENSE') THEN 'other' ELSE lang END AS tag FROM documents""")
def rule_overlay(spark, d):
    rules = spark.createDataFrame([(1, None, ["license", "apache"], "apache"), (2, None, ["license"], "other")], "rule_id int, code string, tokens array<string>, tag string")
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("tag"), "lang")
    out = records.apply_rules(docs, rules, "text", ["tag"])
    return out.select("doc_id", F.coalesce("tag", "lang").alias("tag"))


@query("SELECT vec_id, CAST(sum(CASE WHEN embedding[i] >= 0.1 THEN 1 ELSE 0 END) AS INTEGER) AS marks FROM embeddings, range(1, 13) t(i) GROUP BY vec_id")
def pad_rows(spark, d):
    e = table(spark, d, "embeddings")
    row = records.pad_row(F.transform("embedding", lambda v: F.when(v >= 0.1, F.lit("filled")).otherwise(F.lit(""))), 12)
    return e.select("vec_id", F.size(F.filter(row, lambda v: v == "filled")).alias("marks"))


@query("""WITH c AS (SELECT vec_id, CAST(floor((i - 1) / 8) AS INTEGER) AS r, sum(CASE WHEN embedding[i] >= 0.1 THEN 1 ELSE 0 END) AS n FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2)
SELECT vec_id, sum(n) >= 4 AND max(n) >= 2 AS useful FROM c GROUP BY vec_id""")
def grid_usefulness(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, F.lit(8)), lambda v: v >= 0.1))
    return table(spark, d, "embeddings").select("vec_id", records.informative_grid(rows).alias("useful"))


# -- writes ----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id FROM t""")
def upsert_last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    old, new = e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0")
    keys = ["user_id", "event_type"]
    return relational.upsert(relational.upsert(old.limit(0), old, keys, "event_id"), new, keys, "event_id")


@query("""WITH f AS (SELECT lower(c_mktsegment) AS k, c_nationkey, min(c_custkey) AS a, max(c_custkey) AS b FROM customer GROUP BY 1, 2)
SELECT x.c_mktsegment, f.c_nationkey, f.b AS c_custkey, y.c_acctbal FROM f JOIN customer x ON x.c_custkey = f.a JOIN customer y ON y.c_custkey = f.b""")
def upsert_folded_key(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal")
    return relational.upsert_folded(c, ["c_mktsegment"], ["c_nationkey"], "c_custkey")


@query("""WITH t AS (SELECT s_suppkey AS k, s_acctbal > 5000 AS verified, CAST(s_suppkey % 20 AS BIGINT) AS score, 'old' AS side FROM supplier),
s AS (SELECT s_suppkey + 3 AS k, s_acctbal > 2000 AS verified, CAST(s_suppkey % 13 AS BIGINT) AS score, 'new' AS side FROM supplier),
j AS (SELECT coalesce(t.k, s.k) AS k, s.k IS NULL OR (t.k IS NOT NULL AND ((t.verified AND NOT s.verified) OR t.score > s.score + 4)) AS keep, t.verified AS tv, t.score AS ts, s.verified AS sv, s.score AS ss FROM t FULL OUTER JOIN s ON t.k = s.k)
SELECT k, CASE WHEN keep THEN tv ELSE sv END AS verified, CASE WHEN keep THEN ts ELSE ss END AS score, CASE WHEN keep THEN 'old' ELSE 'new' END AS side FROM j""")
def upsert_guarded(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") > 5000).alias("verified"), (F.col("s_suppkey") % 20).alias("score"), F.lit("old").alias("side"))
    new = s.select((F.col("s_suppkey") + 3).alias("k"), (F.col("s_acctbal") > 2000).alias("verified"), (F.col("s_suppkey") % 13).alias("score"), F.lit("new").alias("side"))
    return relational.upsert_guarded(old, new, "k", "verified", "score")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), CAST(0 AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'""")
def replace_group(spark, d):
    new = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return relational.replace_group(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, ["l_orderkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) GROUP BY l_orderkey")
def retract_cascade(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    _, kept = relational.retract(o, table(spark, d, "lineitem"), "l_orderkey", o.filter("o_totalprice > 200000"), "retracted")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


# -- gates and workflow ----------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '@') AND lang <> 'en' THEN 'address lost' END, CASE WHEN contains(lower(text), 'license') AND n_chars < 3000 THEN 'license lost' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents""")
def completeness_issues(spark, d):
    rules = [(F.contains("text", F.lit("@")), F.col("lang") == "en", "address lost"), (F.contains(F.lower("text"), F.lit("license")), F.col("n_chars") >= 3000, "license lost")]
    return table(spark, d, "documents").select("doc_id", F.array_join(gates.completeness_issues(rules), "; ").alias("issues"))


@query("""SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 0 AND lang = 'en' THEN 'published' WHEN quality = 1 AND toxic = 0 THEN 'awaiting_verification' WHEN toxic = 1 THEN 'rejected' ELSE 'needs_review' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def status_machine(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    found = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic")), lambda v: v.isNotNull())
    return j.select("doc_id", gates.status((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("lang") == "en", found).alias("status"))


@query("""WITH m AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY user_id),
s AS (SELECT m.user_id, m.updated, max(event_type) AS st FROM m JOIN events e ON e.user_id = m.user_id AND e.ts = m.updated GROUP BY 1, 2)
SELECT user_id, CASE WHEN st = 'view' AND updated < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 HOURS THEN 'interrupted' WHEN st = 'view' THEN 'running' ELSE st END AS last_state FROM s""")
def job_latest(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("kind"))
    out = gates.latest_jobs(log.withColumn("kind", F.when(F.col("kind") == "view", "view").otherwise(F.col("kind"))), "2024-01-30 12:00:00", "user_id", "ts", "kind")
    old = F.col("updated") < F.lit("2024-01-30 12:00:00").cast("timestamp") - F.expr("INTERVAL 12 HOURS")
    return out.select("user_id", F.when((F.col("last_state") == "view") & old, "interrupted").when(F.col("last_state") == "view", "running").otherwise(F.col("last_state")).alias("last_state"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def job_retention(spark, d):
    return gates.keep_latest(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


# -- rendering -------------------------------------------------------------------------------


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", render.escape("html").alias("escaped"))


@query("""SELECT p_partkey, '<table><tr><th>Brand</th><th>Size</th></tr><tr><td>' || p_brand || '</td><td>' || CAST(p_size AS VARCHAR) || '</td></tr></table>' AS html FROM part""")
def records_table(spark, d):
    rows = F.array(F.struct(F.col("p_brand").alias("brand"), F.lit(" ").alias("note"), F.col("p_size").cast("string").alias("size")))
    return table(spark, d, "part").select("p_partkey", render.records_table(rows, [("brand", "Brand"), ("note", "Note"), ("size", "Size")]).alias("html"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\\t-\\r ]')), lambda p:
 '<p>' || replace(replace(replace(replace(replace(regexp_replace(p, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>'), ''), '') AS html FROM conversations""")
def markdown_light(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", render.paragraphs("text").alias("html"))


@query(ORACLE_SQL["markdown_light"])
def markdown_light_whole(spark, d):
    return markdown_light(spark, d)


# -- sections and geometry -------------------------------------------------------------------


def _line_pages(spark, d) -> DataFrame:
    """Lines of documents as pages; every seventh opens a section, some say 'continued'."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    head = F.when(F.col("n") % 7 == 0, F.concat(F.lit("AB-"), (F.col("n") / 7 + 1).cast("int").cast("string"), F.lit(" SECTION "))).when(F.col("n") % 11 == 5, F.lit("TABLE OF CONTENTS ")).otherwise("")
    return lines.select(F.col("doc_id").alias("document"), (F.col("n") + 1).alias("page_number"), F.concat(head, "text").alias("text"))


@query()
def section_state_machine(spark, d):
    return sections.split_sections(sections.page_features(_line_pages(spark, d)))


def _words(spark, d) -> DataFrame:
    w = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return geometry.centres(
        w.select("page", "text", (F.col("i") * 37 % 900).cast("double").alias("left"), (F.col("turn") * 60 + F.col("i") % 5 * 9).cast("double").alias("top"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"), F.lit(80.0).alias("confidence"))
    )


@query()
def row_clustering(spark, d):
    rows = geometry.cluster_rows(_words(spark, d))
    return rows.groupBy("page", "row_no").agg(F.count("*").alias("n"), F.round(F.avg("mid_y"), 4).alias("middle"))


@query()
def row_column_text(spark, d):
    rows = geometry.cluster_rows(_words(spark, d)).withColumn("page_width", F.lit(930.0))
    return geometry.row_columns(rows, "page", "page_width")


@query()
def connected_boxes(spark, d):
    return geometry.grid_boxes(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 0.1, least=2, grow=0, padding=0)


@query("""WITH e AS (SELECT vec_id, list_distinct(list_filter(list_transform(embedding, lambda v: CAST(round(abs(v) * 3000) AS INTEGER)), lambda v: v BETWEEN 150 AND 1200 AND abs(v - 25) > 4)) AS a FROM embeddings),
f AS (SELECT vec_id, list_max(list_filter(a, lambda x: x - 175 > 0 AND len(list_filter(range(0, 8), lambda i: len(list_filter(a, lambda y: abs(y - (x - 25 * i)) <= 4)) > 0)) >= 3)) AS b FROM e)
SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda i: CAST(b - 25 * i AS VARCHAR)), ',') AS row FROM f WHERE b IS NOT NULL""")
def progression_rebuild(spark, d):
    e = table(spark, d, "embeddings")
    # A single times an integer is a double here and a single in the SQL: halves would round apart.
    anchors = F.transform("embedding", lambda v: F.round(F.abs(v) * F.lit(3000).cast("float")).cast("int"))
    rows = geometry.rebuilt_rows(e.select("vec_id", anchors.alias("anchors")), "anchors", 25)
    return rows.filter("row is not null").select("vec_id", F.array_join(F.transform("row", lambda v: v.cast("string")), ",").alias("row"))


# -- candidates, drafts, publication -----------------------------------------------------------


@query("""SELECT o_orderkey, a > 0 AND b >= a AND b - a + 1 <= 12 AS safe FROM (SELECT o_orderkey, o_orderkey % 20 AS a, o_orderkey % 20 + o_custkey % 20 - 2 AS b FROM orders)""")
def source_span_gate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("a"), (F.col("o_orderkey") % 20 + F.col("o_custkey") % 20 - 2).alias("b"))
    return o.select("o_orderkey", drafts.safe_span("a", "b").alias("safe"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(c, '^[A-Z]{2,10}-[A-Z0-9]{1,4}$') THEN c ELSE '' END AS code FROM (SELECT p_partkey,
 regexp_replace(regexp_replace(upper(p_brand), '[^A-Z0-9-]', '', 'g'), '^([A-Z]{2,6})([0-9]{1,3})$', '\\1-\\2') AS c FROM part)""")
def identifier_validators(spark, d):
    return table(spark, d, "part").select("p_partkey", facts.system_code("p_brand").alias("code"))


def _priority_orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("problem"), F.col("o_totalprice").alias("link_confidence"), F.lit(0).alias("page_start"), (F.col("o_custkey") % 7).alias("page_end"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("code")
    )


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'F', o_totalprice DESC, o_custkey % 7, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50""")
def processing_priority(spark, d):
    top = _priority_orders(spark, d).orderBy(*drafts.priority(F.col("problem"))).limit(50)
    from pyspark.sql.window import Window

    # Fifty rows are left by the top-k; their places need no more than one task.
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*drafts.priority(F.col("problem")))).cast("long").alias("place"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'F', o_totalprice DESC, o_custkey % 7, o_orderkey) AS place FROM orders""")
def processing_priority_whole(spark, d):
    """A place for every order; the query before gives the first fifty, as its SQL does."""
    return relational.places(_priority_orders(spark, d), drafts.priority(F.col("problem")), "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand)
SELECT p_brand AS code, lo || '-' || hi || ' ' || p_brand || ' ' || array_to_string(types[1:4], ' / ') || CASE WHEN len(types) > 4 THEN ' +' ELSE '' END AS title FROM a""")
def report_title(spark, d):
    apps = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.struct(F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_size").alias("year_from"), F.col("p_size").alias("year_to")))).alias("a"))
    return apps.select(F.col("p_brand").alias("code"), facts.title(F.col("p_brand"), F.col("a")).alias("title"))


@query("""WITH s AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS code, s_acctbal, s_suppkey AS k FROM supplier),
pub AS (SELECT code, 'new' AS body FROM s WHERE k % 3 = 0 AND s_acctbal > 0), blocked AS (SELECT code FROM s WHERE k % 3 = 1 AND s_acctbal < 4000)
SELECT code, body FROM pub UNION ALL SELECT code, 'old' FROM s WHERE k % 2 = 0 AND code NOT IN (SELECT code FROM blocked) AND code NOT IN (SELECT code FROM pub)""")
def export_retained(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"), "s_acctbal", F.col("s_suppkey").alias("k"))
    none, bad = F.array().cast("array<string>"), F.array(F.lit("a fact is missing"))
    row = lambda df, status, issues, body: df.select("code", F.lit(True).alias("verified"), issues.alias("issues"), F.lit(status).alias("status"), F.lit(body).alias("body"))
    existing = row(s.filter("k % 2 = 0"), "published", none, "old")
    current = row(s.filter("k % 3 = 0 and s_acctbal > 0"), "published", none, "new").unionByName(row(s.filter("k % 3 = 1 and s_acctbal < 4000"), "rejected", bad, "no"))
    return drafts.export_seed(existing, current).select("code", "body")


@query(f"""WITH {APPL}, sys AS (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS code, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY make, model, year ORDER BY year_to - year_from, year_from, year_to, code) AS k FROM cand WHERE covered)
SELECT make, model, year, r.code, '{{"found":true,"report_id":"' || lower(r.code) || '","title":"' || year_from || '-' || year_to || ' ' || make || ' ' || model || '","at_a_glance":[{{"label":"Nation","value":"' || n_name
 || '"}}],"vehicle":{{"make":"' || make || '","model":"' || model || '","year_from":' || year_from || ',"year_to":' || year_to || ',"system_code":"' || r.code || '"}}}}' AS payload FROM r JOIN sys ON r.code = sys.code WHERE k = 1""")
def preview_payload(spark, d):
    apps = applications(spark, d)
    s, n = table(spark, d, "supplier").filter("s_acctbal > 0"), table(spark, d, "nation")
    systems = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"), "n_name", F.lit("-").alias("blank"))
    return drafts.preview(lookup.exact(requests(apps), apps), systems, [("n_name", "Nation"), ("blank", "Blank")])


@query("""SELECT 'Brand ' || substring(p_brand, 7) AS make, p_type AS model, 1998 AS year_from, 2002 AS year_to, 'Key' AS system_type, 'AB-' || CAST(p_size AS VARCHAR) AS system_code, p_brand AS source_document, CAST(p_size AS INTEGER) AS source_page, CAST(0.55 AS DOUBLE) AS confidence FROM part""")
def toc_line_candidates(spark, d):
    line = F.concat("p_type", F.lit("  1998-02 Key  AB-"), F.col("p_size").cast("string"), F.lit(" 7"))
    pages = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list(line).alias("l"))
    text_ = F.concat(F.lit("BRAND "), F.substring("p_brand", 7, 9), F.lit("\n"), F.array_join("l", "\n"))
    return candidates.from_toc_lines(pages.select(F.col("p_brand").alias("document"), F.col("p_size").alias("page_number"), text_.alias("text")))


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 60 AS e FROM orders), r AS (SELECT o_orderkey, y, CASE WHEN 1900 + e < y THEN 2000 + e ELSE 1900 + e END AS t FROM o WHERE y < 2000
 UNION ALL SELECT o_orderkey, y, CASE WHEN 2000 + e < y THEN 2100 + e ELSE 2000 + e END FROM o WHERE y >= 2000)
SELECT o_orderkey, CASE WHEN t <= 2035 AND t - y <= 50 THEN CAST(y AS INTEGER) END AS year_from, CASE WHEN t <= 2035 AND t - y <= 50 THEN CAST(t AS INTEGER) END AS year_to FROM r""")
def year_range_lenient(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("a"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0").alias("b"))
    r = years.lenient("a", "b")
    return o.select("o_orderkey", r["year_from"].alias("year_from"), r["year_to"].alias("year_to"))


@query("""SELECT o_orderkey, CAST(2000 + o_orderkey % 30 AS INTEGER) AS year_from, CAST(2000 + o_custkey % 30 AS INTEGER) AS year_to FROM orders""")
def year_range_century(spark, d):
    two = lambda c: F.lpad((F.col(c) % 30).cast("string"), 2, "0")
    r = years.century_optional(F.concat(two("o_orderkey"), F.lit("-"), two("o_custkey")))
    return table(spark, d, "orders").select("o_orderkey", r["year_from"].alias("year_from"), r["year_to"].alias("year_to"))


@query("""SELECT l_orderkey, string_agg(l_linenumber || '=.' || lpad(CAST(q AS VARCHAR), 3, '0'), ',' ORDER BY l_linenumber) AS depths FROM (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def depth_map(spark, d):
    entry = F.concat(F.col("l_linenumber").cast("string"), F.lit(" = ."), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), " ").alias("t"))
    parts = F.transform(F.array_sort(F.map_entries(facts.depth_table("t"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("l_orderkey", F.array_join(parts, ",").alias("depths"))


@query()
def section_drafts(spark, d):
    """Lines of documents as pages, split, drafted and gated: every draft with its status and issues."""
    pages = _line_pages(spark, d)
    secs, found = candidates.build(pages, {"Ford": ["Focus"]}, {"AB": "Ford"})
    gated = drafts.gate(drafts.draft(secs, found).withColumn("verified", F.lit(False)))
    return gated.select("code", "source_document", "page_start", "page_end", "status", "issues", F.to_json("draft").alias("draft"))


@query("""SELECT 'make' AS section, p_brand AS key, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'prefix', split_part(p_type, ' ', 1), count(*) FROM part GROUP BY 2
UNION ALL SELECT 'flags', 'low confidence', count(*) FROM part WHERE p_size / 50.0 < 0.65 UNION ALL SELECT 'flags', 'suspicious', count(*) FROM part WHERE length(p_name) NOT BETWEEN 2 AND 45""")
def parser_quality(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("system_code"), (F.col("p_size") / 50.0).alias("confidence"))
    return candidates.quality_report(c)


# -- extensions: the reference has none of these ---------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    return incremental.tumbling(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 2))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, d):
    return incremental.sessions(table(spark, d, "events"), "6 hours")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


from . import asset_queries, draft_queries, map_queries, more, pages, rules, vehicles  # noqa: E402, F401  they register their queries here
