import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import facts
from quirework.plans import candidates, drafts


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_toc_lines(spark):
    text = "FORD\nFocus  2000-05  Transponder  FO-12 page 3\nno years FO-1\n2001-02 FO-3\nOPEL GM\nAstra G 1998–02 Key OP–A1"
    df = spark.createDataFrame([("doc", 7, text), ("other", 1, "Focus 2000-05 FO-12")], "document string, page_number int, text string")
    assert rows(candidates.from_toc_lines(df)) == [
        ("Ford", "Focus", 2000, 2005, "Transponder", "FO-12", "doc", 7, 0.55),
        ("Opel Gm", "Astra G", 1998, 2002, "Key", "OP-A1", "doc", 7, 0.55),
    ]


def test_toc_columns(spark):
    df = spark.createDataFrame([("M", "d", 1, ["A", "B", "-", "C"], ["2000-01", "2002-03", "2004-05", "x"], ["Key"], ["ab_1", "AB-2", "AB-3", "AB-4"])], "make string, source_document string, source_page int, models array<string>, years array<string>, types array<string>, codes array<string>")
    got = candidates.from_toc_columns(df).orderBy("year_from").collect()
    assert [(r["model"], r["year_from"], r["system_type"], r["system_code"]) for r in got] == [("A", 2000, "Key", "AB-1"), ("B", 2002, "", "AB-2"), ("B", 2004, "", "AB-3")]


SECTION = "FO-1 SECTION 2000-05 Focus remote, 2003-975 Ka (Ford) and some other words 2010-12 Gruppo (Fiat) KEYS 2014-15 Late"


def section(spark, raw=SECTION):
    return spark.createDataFrame([("FO-1", "doc", 3, 3, raw, "Ford", 0.6)], "code string, source_document string, page_start long, page_end long, raw_text string, default_make string, confidence double")


def test_header_chunks(spark):
    got = [(r["year_from"], r["year_to"], r["model"]) for r in candidates.header_chunks(section(spark)).collect()]
    assert got == [(2000, 2005, "Focus"), (2010, 2012, "Gruppo (Fiat)")]  # 2003-975 is no range; nothing after KEYS


def test_canonical_and_loose_applications(spark):
    vocabulary = {"Ford": ["Focus", "Ka"], "Fiat": ["Gruppo"]}
    got = {(r["make"], r["model"]): r["confidence"] for r in candidates.from_sections(section(spark), vocabulary).collect()}
    # 'doc' names no make, so a make in parentheses alone brings no known model of another one; the loose reading does.
    assert got == {("Ford", "Focus"): 0.92, ("Fiat", "Gruppo"): pytest.approx(0.9)}


def test_facts(spark):
    text = "Chip: Philips 46 Reusable: yes Code Series: A1-9 CARD# C12 MACS: 7 315MHz 433 MHz FCC ID: ABC12 FCC INFO: xxxxx part 1234567AB 12345-67890 HU101 spacing .900 .850 1=.340 2=.325 1=.300"
    v = one(spark, facts.labelled, text)
    assert (v["chip"], v["code_series"], v["card"], v["macs"], v["frequency"]) == ("Philips 46", "A1-9", "C12", "7", "315")
    ids = one(spark, facts.identifiers, text)
    assert ids["parts"] == ["12345-67890", "1234567AB"] and ids["frequencies"] == ["315 MHz", "433 MHz"] and ids["fcc_ids"] == ["ABC12"] and ids["keyways"] == ["HU101"]
    assert one(spark, facts.depth_table, text) == {"1": ".300", "2": ".325"}
    assert one(spark, facts.spacing_values, "SPACING .900 850 800 DEPTHS 1=.300") == [900, 850, 800]
    assert one(spark, facts.spacing_values, "900 850") == []
    assert [one(spark, facts.system_code, x) for x in ("fo12", "FO-12", "12", "FO", " ab-1- ")] == ["FO-12", "FO-12", "", "", "AB-1"]
    assert [x["part"] for x in one(spark, facts.remote_options, "Remote 1234567 315MHz. Remote 1234567 315MHz\nFob none")] == ["1234567"]


@pytest.mark.parametrize("apps, expected", [([], "X-1 Vehicle Reference"), ([("B", "m1", 2000, 2003), ("A", "m2", 1999, None), ("C", "m1", 2001, 2002)], "1999-2003 A / B + m1 / m2")])
def test_title(spark, apps, expected):
    df = spark.createDataFrame([("X-1", apps)], "c string, a array<struct<make:string,model:string,year_from:int,year_to:int>>")
    assert df.select(facts.title(F.col("c"), F.col("a")).alias("t")).first()["t"] == expected


def test_drafts_are_gated(spark):
    raw = "FO-1 proximity remote 315 MHz Code Series: A1-9 PIN needed"
    apps = spark.createDataFrame([("Ford", "Focus", 2000, 2005, "Key", "FO-1", "doc", 3, 0.9)], "make string, model string, year_from int, year_to int, system_type string, system_code string, source_document string, source_page int, confidence double")
    secs = section(spark, raw).unionByName(section(spark, raw + " Chip: Philips é SPACING 1").withColumn("code", F.lit("FO-2")))
    gated = drafts.gate(drafts.draft(secs, apps).withColumn("verified", F.lit(True)))
    got = {r["code"]: (r["status"], r["issues"]) for r in gated.collect()}
    assert got["FO-1"] == ("published", [])
    assert got["FO-2"][0] == "rejected" and "spacing" in got["FO-2"][1]
    t = drafts.tallies(gated).first()
    assert (t["published"], t["rejected"], t["awaiting"], t["review"]) == (1, 1, 0, 0)


def test_eligibility_and_priority(spark):
    s = "code string, page_start int, page_end int, confidence double"
    secs = spark.createDataFrame([("A-1", 1, 12, 0.6), ("A-2", 1, 13, 0.6), ("A-3", 0, 1, 0.6), ("A-4", 5, 4, 0.6), ("A-5", 1, 1, 0.5), ("A-6", 2, 2, 0.6), ("A-6", 3, 3, 0.6)], s)
    assert [r["code"] for r in drafts.eligible(secs, 0.6).orderBy("code").collect()] == ["A-1", "A-6", "A-6"]
    assert rows(drafts.repeated_codes(secs)) == [("A-6", 2)]
    apps = spark.createDataFrame([("A-6", 0.9)], "system_code string, confidence double")
    ranked = drafts.link_confidence(secs, apps).orderBy(*drafts.priority(F.col("code") == "A-6")).collect()
    assert ranked[-1]["code"] == "A-6" and ranked[0]["link_confidence"] == 0.0


def test_seed_export(spark):
    s = "code string, verified boolean, issues array<string>, status string, body string"
    old = spark.createDataFrame([("A", True, [], "published", "old"), ("B", True, [], "published", "old"), ("C", True, ["x"], "published", "old"), ("D", True, [], "published", "old")], s)
    new = spark.createDataFrame([("A", True, ["bad"], "rejected", "n"), ("B", True, [], "published", "new"), ("D", False, ["Awaiting verification"], "rejected", "n")], s)
    assert {r["code"]: r["body"] for r in drafts.export_seed(old, new).collect()} == {"B": "new", "D": "old"}


def test_preview(spark):
    m = spark.createDataFrame([("Ford", "Focus", 2004, 2000, 2005, "FO-1")], "make string, model string, year int, year_from int, year_to int, code string")
    s = spark.createDataFrame([("FO-1", "Required", "n/a"), ("X", "", "")], "code string, pin string, freq string")
    p = json.loads(drafts.preview(m, s, [("pin", "PIN"), ("freq", "Frequency")]).first()["payload"])
    assert p["title"] == "2000-2005 Ford Focus" and p["at_a_glance"] == [{"label": "PIN", "value": "Required"}] and p["vehicle"]["system_code"] == "FO-1"


def test_build_and_report(spark):
    pages = spark.createDataFrame([("d", 1, "FO-1 SECTION 2000-05 Focus remote"), ("d", 2, "more text"), ("d", 3, "FORD\nKa 1998-02 Key FO-9")], "document string, page_number int, text string")
    secs, found = candidates.build(pages, {"Ford": ["Focus"]}, {"FO": "Ford"})
    assert rows(secs.select("code", "page_start", "page_end")) == [("FO-1", 1, 3)]
    assert {(r["model"], r["confidence"]) for r in found.collect()} >= {("Focus", 0.92), ("Ka", 0.55)}
    stats = spark.createDataFrame([("d", 1, 30, 2, None), ("d", 2, 5, 1, None), ("d", 3, 30, None, None)], "document string, page int, words int, candidates int, error string")
    report = {(r["section"], r["key"]): r["n"] for r in candidates.quality_report(found, stats).collect()}
    assert report[("make", "Ford")] >= 2 and ("weak page", "d:2") in report and ("weak page", "d:3") in report and report[("flags", "low confidence")] >= 1


def test_toc_words(spark):
    def row(y, *cells):
        return [("d", 1, 1000, t, float(x), float(y), 20.0, 10.0, 80.0) for x, t in cells]

    words = row(0, (300, "Model")) + row(40, (250, "Focus"), (520, "2000-05"), (640, "Remote"), (750, "FO_1"), (900, "7")) + row(80, (520, "2006-08"), (750, "FO-2"))
    df = spark.createDataFrame(words, "document string, page int, page_width int, text string, left double, top double, width double, height double, confidence double")
    makes = spark.createDataFrame([("d", 1, "Ford"), ("d", 2, "Ford")], "document string, page int, make string")
    found, stats = candidates.from_toc_words(df, makes)
    assert sorted((r["model"], r["year_from"], r["system_type"], r["system_code"], r["confidence"]) for r in found.collect()) == [("Focus", 2000, "Remote", "FO-1", 0.8), ("Focus", 2006, "Key", "FO-2", 0.8)]
    assert rows(stats) == [("d", 1, 8, 2, None), ("d", 2, None, None, "missing image")]
