"""Lock maps on hand-made diagrams."""

import pytest
from pyspark.sql import functions as F

from quirework.functions import lock_maps
from quirework.operators import gates

TEN = [str(i) for i in range(1, 11)]
SOURCE = "CUTTING THE KEY 10 CUT 1 2 3 4 5 6 7 8 9 10 IGNITION 5 DOORS 5 6 TRUNK 6 SPARE TIRE STOWAGE GLOVE BOX positions"


def diagram(title="x lock-position map", columns=TEN, rows=(("Ignition", "filled"),), label="p", placement="making_key"):
    return (title, placement, None, [(label, list(columns), [list(r) for r in rows], None)])


def frame(spark, *rows):
    """code, keyway, source, diagrams"""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, code string, keyway string, source string, diagrams {lock_maps.DIAGRAMS}")


def first_rows(spark, *rows):
    out = frame(spark, *rows).select("i", lock_maps.enforce("diagrams", "code", "keyway").alias("d")).orderBy("i").collect()
    return [[list(x) for x in r["d"][0]["panels"][0]["rows"]] if r["d"] else r["d"] for r in out]


def test_verified_rows_replace_what_contradicts_them(spark):
    rows = (("Ignition lock", *["filled"] * 10), ("left DOOR", "", "filled"), ("Fuel cap", "filled"), ())
    got = first_rows(
        spark,
        ("gm-p10", None, None, [diagram(rows=rows)]),
        ("XX-1", None, None, [diagram(rows=rows)]),
        ("GM-P10", None, None, [diagram(title="blade", rows=rows)]),
        ("GM-P10", None, None, [diagram(columns=TEN[:8], rows=rows)]),
        ("AV-8", "HU100", None, [diagram(columns=TEN[:8], rows=rows)]),
        ("AV-8", "hu66", None, [diagram(columns=[f" {c} " for c in TEN[:8]], rows=rows)]),
        (None, None, None, None),
        ("GM-P10", None, None, []),
    )
    same = [list(r) for r in rows]
    assert got[0] == [["Ignition lock", *[""] * 10], ["left DOOR", *[""] * 4, *["filled"] * 6], ["Fuel cap", "filled"], []]
    assert got[1:5] == [same] * 4
    assert got[5] == [["Ignition lock", *["filled"] * 8], ["left DOOR", *["filled"] * 8], ["Fuel cap", "filled"], []]
    assert got[6:] == [None, []]


@pytest.mark.parametrize(
    "columns, rows, useful",
    [
        (TEN, [("Ignition", "filled", "filled"), ("Door", "filled", "FILLED ")], True),
        (TEN, [("Ignition", "filled", "filled"), ("Door", "filled")], False),
        (TEN, [("Ignition", "filled"), ("Door", "filled"), ("Trunk", "filled"), ("Glove", "filled")], False),
        (TEN, [("Horn", "filled", "filled", "filled", "filled")], False),
        (TEN[:6], [("Ignition", "filled", "filled", "filled", "filled")], False),
        (TEN[:5], [("Ignition", *[""] * 5, "filled", "filled", "filled", "filled")], False),  # beyond the columns
        (lock_maps.DOUBLED, [("Hatch", "filled", "filled", "filled", "filled")], True),
    ],
)
def test_informative(spark, columns, rows, useful):
    df = frame(spark, ("A", None, None, [diagram(columns=columns, rows=rows)]))
    assert df.select(lock_maps.informative(F.col("diagrams")[0]).alias("u")).first()["u"] is useful


def test_a_map_is_inferred_where_none_says_anything(spark):
    useful = diagram(rows=[("Ignition", "filled", "filled"), ("Door", "filled", "filled")])
    df = frame(spark, ("A", "B106", SOURCE, None), ("A", None, SOURCE, [diagram()]), ("A", None, SOURCE, [useful]), ("A", None, SOURCE.replace("STOWAGE", ""), []), ("A", None, None, None))
    got = [r["d"] for r in df.select("i", lock_maps.infer("diagrams", "source", "keyway", F.lit(None).cast("string")).alias("d")).orderBy("i").collect()]
    assert [len(d) for d in got] == [1, 2, 1, 0, 0]
    made = got[0][0]
    assert made["title"] == "B106 lock-position guide" and got[1][1]["title"] == "10-cut key lock-position guide"
    assert list(made["panels"][0]["rows"][5]) == ["Glove box", *[""] * 6, "filled", "filled", "filled", ""]


def test_cut_tables_come_from_the_last_whole_panel(spark):
    spacing = lambda *values, **kw: diagram(columns=[str(i + 1) for i in range(len(values))], rows=[values], label=" Spacing ", **kw)
    df = frame(
        spark,
        ("A", None, None, [spacing(".900", " .800 "), spacing("1", "2", "3"), spacing("x", "2"), spacing("9", placement="programming"), diagram(columns=["1", "1", " "], rows=[[".1", ".2", ".3"]], label="DEPTH")]),
        ("A", None, None, []),
        ("A", None, None, None),
        ("A", None, None, [diagram(columns=["1"], rows=[], label="spacing")]),
    )
    got = [(r["s"], r["d"]) for r in df.select("i", lock_maps.cut_table("diagrams", "spacing").alias("s"), lock_maps.cut_table("diagrams", "depths").alias("d")).orderBy("i").collect()]
    assert got == [({"1": "1", "2": "2", "3": "3"}, {"1": ".2"}), (None, None), (None, None), (None, None)]


def test_best_of_reads(spark):
    reads = [(1, 0, "a b"), (1, 1, "a key b"), (1, 2, "a key b"), (2, 0, None), (2, 1, ""), (3, 0, "x±¤"), (3, 1, "x")]
    got = gates.best_read(spark.createDataFrame(reads, "page int, pass int, t string"), ["page"], "t", "pass").collect()
    assert sorted((r["page"], r["pass"]) for r in got) == [(1, 1), (2, 0), (3, 1)]
