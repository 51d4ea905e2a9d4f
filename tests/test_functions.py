import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.functions import images, records, render, similarity, text, years


def values(spark, rows, **columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def test_ocr_clean(spark):
    rows = ["СОДЕ  – x™", " a\n\n\n\nb\t c ", "", None, "don’t “go”"]
    got = [r["v"] for r in values(spark, rows, v=text.ocr_clean("c0"))]
    assert got == ["COДЕ - x".replace("Д", "Д"), "a\n\nb c", "", None, 'don\'t "go"']


def test_quality_points_against_python(spark):
    r = random.Random(4)
    rows = ["".join(r.choice("aZ9 é±[}{]b\n") for _ in range(40)) + r.choice(["", " FCC id", " remote pin", " keyless"]) for _ in range(50)]

    def expected(t):
        terms = len(re.findall(r"\b(?:" + "|".join(text.DOMAIN_TERMS) + r")\b", t, re.I | re.A))
        return 100 * len(re.findall("[A-Za-z]", t)) + 15 * t.count(" ") + 1200 * terms - 800 * len(re.findall(r"[^\x00-\x7F]", t)) - 500 * len(re.findall(r"[±¤\[\]{}]|[A-Za-z]\d[A-Za-z]", t))

    ascii_edges = [t for t in rows if not re.search(r"[^\x00-\x7f](?:FCC|remote|pin)|(?:id|pin|remote)[^\x00-\x7f]", t)]
    assert [r["v"] for r in values(spark, ascii_edges, v=text.quality_points("c0"))] == [expected(t) for t in ascii_edges]


def test_choose_text(spark):
    good, bad = "Remote key code " * 8, "±± [ ] " * 12
    rows = [(good, bad), (bad, good), ("", "x"), ("x", ""), (None, None), ("short", "Remote fob with chip and transponder, good text")]
    got = [r["v"] for r in values(spark, rows, v=text.choose_text("c0", "c1"))]
    assert got == [good, good, "x", "x", "", rows[5][1]]


@pytest.mark.parametrize(
    "raw, expected",
    [("1998-02", (1998, 2002)), ("2016-21", (2016, 2021)), ("2015-2017", (2015, 2017)), ("1975-845", (1975, 1984)), ("2015-", None), ("2018-1999", None), ("1899-1910", None), ("2030-2099", None), ("1998–02", (1998, 2002)), ("x 1990 - 95 y", (1990, 1995)), ("", None), (None, None)],
)
def test_years_strict(spark, raw, expected):
    got = values(spark, [(raw,)], v=years.strict("c0"))[0]["v"]
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    "start, end, expected",
    [("2015", "", (2015, 2015)), ("2015", None, (2015, 2015)), ("2018", "1999", (2018, 1999)), ("2010", "2099", (2010, 2020)), ("1998", "02", (1998, 2002)), ("1900", "99", None), ("1975", "845", (1975, 1984)), ("1990", "012", None), ("1899", "10", None)],
)
def test_years_lenient(spark, start, end, expected):
    got = values(spark, [(start, end)], v=years.lenient("c0", "c1"))[0]["v"]
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize("raw, expected", [("98-02", (2098, 2002)), ("1998", (1998, 1998)), ("12", (2012, 2012)), ("2012-2015", (2012, 2015)), ("1998-02x", None), (" 05-09 ", (2005, 2009)), (None, None)])
def test_years_third(spark, raw, expected):
    got = values(spark, [(raw,)], v=years.century_optional("c0"))[0]["v"]
    assert (got and tuple(got)) == expected


def test_codes(spark):
    rows = ["ab_1", "ABCDE1", "AB-12", "AB-C9", "??", "ABCD-X2 z"]
    got = values(spark, rows, code=text.section_code("c0"), n=text.numeric_suffix("c0"), nxt=text.next_code("c0"))
    assert [r["code"] for r in got] == ["AB-1", "ABCD-E1", "AB-12", "AB-C9", "", "ABCD-X2Z"]
    assert [r["n"] for r in got] == [None, None, 12, None, None, None]
    assert [r["nxt"] for r in got] == ["", "", "AB-13", "AB-C10", "", ""]


def test_link_points(spark):
    rows = [("A", "Focus", "A"), ("B", "Focus", "A"), ("A", "F150", "A"), ("A", "x" * 30, "A"), ("A", "bad)", "A"), ("", "3 " + "y" * 30 + ".", "")]
    assert [r["v"] for r in values(spark, rows, v=text.link_points("c0", "c1", "c2"))] == [76, 84, 70, 64, 60, 42]
    assert values(spark, rows[:1], v=text.link_points("c0", "c1", "c2", F.lit(0.9)))[0]["v"] == 84


def test_gates_of_text(spark):
    rows = ["fine text for the public to read", "café", "1234567890 1234567890 12345 x", "short 1", ""]
    assert [r["v"] != "" for r in values(spark, rows, v=text.public_text("c0"))] == [True, False, False, True, False]
    names = ["Model (x", "AB", "x", "a name with 1 digit in it", "ok 9"]
    assert [r["v"] for r in values(spark, names, v=text.suspicious_name("c0"))] == [True, False, True, True, False]
    assert values(spark, ["One. Two.\n\nThree"], v=text.sentences("c0"))[0]["v"] == ["One.", "Two.", "Three"]


def test_best_match_is_difflib(spark):
    assert similarity.best_match("Focsu", ["Focus", "Fiesta"])[0] == "Focus"
    assert similarity.best_match("", ["Focus"]) == ("Focus", 0.9)
    assert similarity.best_match("zzz", ["Focus"])[0] == "zzz"
    df = spark.createDataFrame([("f", "Focsu"), ("f", "Grand Focus"), ("g", "Focus"), (None, None)], "make string, model string")
    got = {(r["make"], r["model"]): (r["canonical"], round(r["score"], 4)) for r in similarity.canonicalize(df, {"f": ["Focus", "Fiesta"]}, "make", "model").collect()}
    assert got == {("f", "Focsu"): ("Focus", 0.8), ("f", "Grand Focus"): ("Focus", 0.9), ("g", "Focus"): ("Focus", 0.0), (None, None): ("", 0.0)}


def test_trigrams(spark):
    rows = [("word", "two words"), ("", "x"), ("same", "SAME")]
    got = [r["v"] for r in values(spark, rows, v=similarity.trigram_similarity("c0", "c1"))]
    assert round(got[0], 6) == round(4 / 11, 6) and got[1] == 0 and got[2] == 1


KIND = "struct<a:string,b:array<struct<c:string,d:array<string>>>,m:map<string,string>,n:int>"


def nested(spark):
    row = ({"a": " ", "b": [{"c": "x ", "d": ["", "bad word"]}, {"c": "", "d": []}], "m": {"k": "", "l": " v"}, "n": 0},)
    none = ({"a": "", "b": [], "m": {}, "n": None},)
    return spark.createDataFrame([(1, *row), (2, *none), (3, None)], f"i int, r {KIND}")


def test_prune(spark):
    df = nested(spark)
    got = [r["p"] for r in df.select(records.prune(F.col("r"), df.schema["r"].dataType).alias("p")).orderBy("i").collect()]
    assert got[0].asDict(True) == {"a": None, "b": [{"c": "x", "d": ["bad word"]}], "m": {"l": "v"}, "n": 0}
    assert got[1] is None and got[2] is None


def test_issue_paths(spark):
    df = nested(spark)
    got = df.filter("i = 1").select(records.issues(F.col("r"), df.schema["r"].dataType, ["BAD", "^ v"]).alias("x")).first()["x"]
    assert got == ["report.b[0].d[1]: bad word", "report.m.l:  v"]


def test_merge_and_patch(spark):
    schema = "b struct<x:string,y:struct<z:int,w:string>,m:map<string,int>>, o struct<x:string,y:struct<z:int,w:string>,m:map<string,int>>"
    df = spark.createDataFrame([({"x": "1", "y": {"z": 1, "w": "a"}, "m": {"p": 1, "q": 2}}, {"x": None, "y": {"z": 5, "w": None}, "m": {"q": 9}}), ({"x": "1", "y": None, "m": None}, None)], schema)
    kind = df.schema["b"].dataType
    got = [r["v"].asDict(True) for r in df.select(records.merge(F.col("b"), F.col("o"), kind).alias("v")).collect()]
    assert got == [{"x": "1", "y": {"z": 5, "w": "a"}, "m": {"p": 1, "q": 9}}, {"x": "1", "y": None, "m": None}]
    some = df.select(records.patch(F.col("b"), F.col("o"), kind, ["m"]).alias("v")).first()["v"].asDict(True)
    assert some == {"x": "1", "y": {"z": 1, "w": "a"}, "m": {"p": 1, "q": 9}}


def test_arrays_and_tables(spark):
    df = spark.createDataFrame([(["a", "b"], {"1": ".9", "2": ".5", "3": "x"}, [[True, True], [True, True]])], "r array<string>, t map<string,string>, g array<array<boolean>>")
    got = df.select(
        records.pad_row(F.col("r"), 4).alias("long"), records.pad_row(F.col("r"), 1).alias("short"), records.descending_table(F.col("t"), 2).alias("d2"), records.descending_table(F.col("t"), 3).alias("d3"),
        records.bounded_table(F.col("t"), 2, 0.05, 1.25).alias("b"), records.informative_grid(F.col("g")).alias("g"), records.position_row(F.lit("DOOR"), F.array(F.lit(2)), 3).alias("p"),
    ).first()
    assert (got["long"], got["short"], got["d2"], got["d3"], got["b"], got["g"], got["p"]) == (["a", "b", "", ""], ["a"], True, False, False, True, ["DOOR", "", "filled", ""])


def test_rendering(spark):
    df = spark.createDataFrame([("<a> & 'b'", ["x<", "y"], [("1", None), ("", None)], [2])], "t string, l array<string>, r array<struct<a:string,b:string>>, p array<int>")
    got = df.select(
        render.escape("t").alias("e"), render.escape("t", render.LEGACY).alias("e4"), render.listing(F.col("l")).alias("l"), render.records_table(F.col("r"), [("a", "A"), ("b", "B")]).alias("r"),
        render.position_map(F.col("p"), 3).alias("p"), render.panel("T", F.lit("")).alias("none"), render.paragraphs(F.lit("a\n\n \n\nb<")).alias("m"), render.sql_literal(F.col("t")).alias("s"),
    ).first()
    assert got["e"] == "&lt;a&gt; &amp; &#x27;b&#x27;" and got["e4"] == "&lt;a&gt; &amp; 'b'"
    assert got["l"] == "<ul><li>x&lt;</li><li>y</li></ul>"
    assert got["r"] == '<table><tr><th>A</th></tr><tr><td>1</td></tr><tr><td><span class="empty-cell">-</span></td></tr></table>'
    assert got["p"] == "<td>-</td><td>x</td><td>-</td>" and got["none"] == "" and got["m"] == "<p>a</p><p>b&lt;</p>" and got["s"] == "'<a> & ''b'''"


def test_image_decisions(spark):
    df = spark.createDataFrame([("table", False, True), ("photo", True, True), ("photo", False, True), (None, None, None)], "k string, t boolean, e boolean")
    got = [r["u"]["public_kind"] for r in df.select(images.use_of(F.col("k"), F.col("t"), F.col("e")).alias("u")).collect()]
    assert got == ["structured_data", "structured_data", "procedure_image", "discard"]


def test_boxes_and_ink(spark):
    grid = [[255] * 10 for _ in range(10)]
    for y in range(2, 6):
        grid[y][3] = grid[y][7] = 0
    df = spark.createDataFrame([((5, 5, 100, 90), 1000, 1000, grid, [(250, 250, 250), (200, 180, 170), (10, 10, 10)])], "b struct<x1:int,y1:int,x2:int,y2:int>, w int, h int, g array<array<int>>, p array<struct<r:int,g:int,b:int>>")
    r = df.select(images.expand_box(F.col("b"), F.col("w"), F.col("h"), 10).alias("e"), images.plausible_box(F.col("b"), F.col("w"), F.col("h")).alias("ok"), images.ink(F.col("g"), 128).alias("i"), images.good_ink(F.col("g")).alias("good"), images.suppress_watermark(F.col("p")).alias("p"), images.has_cue(F.lit("Remove the lock"), ["lock"]).alias("cue")).first()
    assert tuple(r["e"]) == (0, 0, 110, 100) and r["ok"] and tuple(r["i"]) == (0.08, 5, 4) and r["good"] and r["cue"]
    assert [tuple(x) for x in r["p"]] == [(255, 255, 255), (255, 255, 255), (10, 10, 10)]


def test_display_names_and_responses(spark):
    df = spark.createDataFrame([("f", "Focsu"), ("f", "zzz"), ("g", "zzz"), ("g", "bad (")], "make string, model string")
    got = {(r["make"], r["model"]): r["display"] for r in similarity.display_names(df, {"f": ["Focus"]}, "make", "model", text.suspicious_name("model")).collect()}
    assert got == {("f", "Focsu"): "Focus", ("f", "zzz"): "", ("g", "zzz"): "zzz", ("g", "bad ("): ""}
    rows = ['{"output_text": " hi "}', '{"output": [{"content": [{"type": "text", "text": "a"}, {"type": "image"}]}, {"content": [{"type": "output_text", "text": "b"}]}]}', "{}", "nope", None]
    assert [r["v"] for r in values(spark, rows, v=records.response_text(F.col("c0")))] == ["hi", "a\nb", None, None, None]
    assert values(spark, ["HU-io2"], v=similarity.decoder_fold("c0"))[0]["v"] == "HU102"
