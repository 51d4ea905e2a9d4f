"""Refreshed drafts against a full build, and which were made anew; the asset scan on small tables."""

from pyspark.sql import functions as F

from quirework.operators import assets
from quirework.plans import drafts, refresh

SECTION = "code string, source_document string, page_start long, page_end long, raw_text string, default_make string, confidence double"
APPS = "make string, model string, year_from int, year_to int, system_type string, system_code string, source_document string, source_page int, confidence double"


def test_only_what_changed_is_made_anew(spark, tmp_path):
    old = [("FO-1", "d", 1, 2, "proximity 315 MHz", "Ford", 0.6), ("FO-2", "d", 3, 4, "transponder", "Ford", 0.6), ("FO-3", "d", 5, 5, None, "Ford", 0.6), ("FO-4", "d", 6, 7, "goes", "Ford", 0.6), ("FO-5", "d", 8, 9, "PIN", "Ford", 0.6)]
    new = [old[0], ("FO-2", "d", 3, 4, "transponder 433 MHz", "Ford", 0.6), old[2], ("FO-5", "d", 8, 10, "PIN", "Ford", 0.6), ("FO-6", "d", 11, 11, "new", "Ford", 0.6), ("FO-7", "d", 12, 12, "apps", "Ford", 0.6)]
    old.append(("FO-7", "d", 12, 12, "apps", "Ford", 0.6))
    apps = lambda year: spark.createDataFrame([("Ford", "Ka", 1999, year, "Key", "FO-7", "d", 12, 0.9), ("Ford", "Edge", 2001, 2002, "Key", "FO-1", "d", 1, 0.9)], APPS)
    path = str(tmp_path / "drafts")
    refresh.refresh(spark.createDataFrame(old, SECTION), apps(2004)).write.parquet(path)
    now = spark.createDataFrame(new, SECTION)
    got = refresh.refresh(now, apps(2005), spark.read.parquet(path))
    whole = refresh.refresh(now, apps(2005))
    shown = lambda df: sorted(tuple(r) for r in df.select("code", "page_start", "page_end", "source_key", F.to_json("draft")).collect())
    rows = got.select("code", "page_start", "page_end", "source_key", F.to_json("draft").alias("j"), "rebuilt").collect()
    assert sorted(tuple(r)[:5] for r in rows) == shown(whole)
    assert {r["code"]: r["rebuilt"] for r in rows} == {"FO-1": False, "FO-2": True, "FO-3": False, "FO-5": True, "FO-6": True, "FO-7": True}


def test_asset_scan(spark):
    pages = spark.createDataFrame([("a", 1, "AB-1", True), ("a", 2, None, True), ("a", 3, None, False), ("a", 4, "bad", True), ("b", 1, None, True), ("c", 1, "ZZ-9", True)], "document string, page_number int, code string, fit boolean")
    box = lambda d, p, *sizes: [(d, p, i, w, h) for i, (w, h) in enumerate(sizes)]
    rows = box("a", 1, (300, 100), (279, 100), (300, 99), (300, 300)) + box("a", 2, *[(300, 300)] * 4) + box("a", 3, (300, 300)) + box("a", 4, (300, 300)) + box("b", 1, (300, 300)) + box("c", 1, (300, 300))
    boxes = spark.createDataFrame(rows, "document string, page_number int, box int, width int, height int")
    known = {("a", 2, 0): "{}", ("a", 2, 1): None, ("a", 2, 2): "{}"}
    keys = boxes.withColumn("asset_id", assets.asset_id(F.col("document"), F.col("page_number"), F.col("box"))).collect()
    ids = {(r["document"], r["page_number"], r["box"]): r["asset_id"] for r in keys}
    cache = spark.createDataFrame([(ids[k], v) for k, v in known.items()] + [(ids["a", 2, 0], "{}")], "asset_id string, diagram string")
    scan = lambda budget, allowed=None: {(r["document"], r["page_number"], r["box"]): (r["system_code"], r["status"]) for r in assets.scan(pages, boxes, cache, F.col("fit"), F.col("code"), budget, allowed).collect()}
    assert scan(2) == {
        ("a", 1, 0): ("AB-1", "request"),
        ("a", 1, 3): ("AB-1", "request"),
        ("a", 2, 0): ("AB-1", "ready"),
        ("a", 2, 1): ("AB-1", "none"),
        ("a", 2, 2): ("AB-1", "ready"),  # the fourth box stands behind two ready ones
        ("c", 1, 0): ("ZZ-9", "waiting"),
    }
    assert set(scan(9, spark.createDataFrame([("ZZ-9",), ("ZZ-9",)], "code string"))) == {("c", 1, 0)}
    assert assets.scan(pages.limit(0), boxes, cache, F.col("fit"), F.col("code"), 5).count() == 0


def test_report_assets(spark):
    rows = [("AB-1", True, [], [("t", 1)] * 4), ("AB-2", False, [], [("t", 1)]), ("AB-3", True, ["x"], [("t", 1)]), ("bad", True, [], [("t", 1)]), ("AB-4", True, None, [None, ("u", 2)]), ("AB-5", True, [], None)]
    out = assets.from_reports(spark.createDataFrame(rows, "code string, verified boolean, issues array<string>, diagrams array<struct<title:string,n:int>>")).collect()
    assert sorted((r["system_code"], r["place"]) for r in out) == [("AB-1", 0), ("AB-1", 1), ("AB-1", 2), ("AB-4", 1)]
    assert len({r["asset_id"] for r in out}) == 4


def test_sections_of_one_code_are_drafted_in_many_tasks(spark):
    """The join by code puts them into one; drafting costs too much to stay there."""
    secs = spark.createDataFrame([("FO-1", "d", i, i, "proximity 315 MHz", "Ford", 0.6) for i in range(64)], SECTION)
    apps = spark.createDataFrame([("Ford", "Ka", 1999, 2004, "Key", "FO-1", "d", 12, 0.9)], APPS)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    made = drafts.draft(secs, apps).groupBy(F.spark_partition_id()).count().collect()
    for k in settings:
        spark.conf.unset(k)
    parts = [r["count"] for r in made]
    assert sum(parts) == 64 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) <= 32


def test_texts_are_split_and_drafted_once(spark, tmp_path):
    """Sections are read from what was written, not split again by each of their uses; so are earlier drafts."""
    from quirework.plans import candidates

    pages = spark.createDataFrame([("d", 1, "AB-1 SECTION proximity 315 MHz"), ("d", 2, "AB-2 SECTION transponder")], "document string, page_number int, text string")
    secs, found = candidates.build(pages, {"Ford": ["Focus"]}, {"AB": "Ford"})
    plan = refresh.refresh(secs, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" in plan
    assert {r["code"] for r in refresh.refresh(secs, found).collect()} == {"AB-1", "AB-2"}


def test_cleaning_does_not_double_at_each_level(spark):
    """The cleaning of a string in an array is in the plan once."""
    from quirework.functions import records

    df = spark.createDataFrame([([["  a ", " "], []],)], "x array<array<string>>")
    kind = df.schema["x"].dataType
    out = df.select(records.prune(F.col("x"), kind).alias("p"))
    assert out._jdf.queryExecution().analyzed().toString().count("trim(") == 1
    assert out.first()["p"] == [["a"]]
