import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.operators import gates, geometry, lookup, relational, search, sections
from quirework.sources import files
from quirework.streaming import incremental


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


APPS = [("Ford", "Focus", 2000, 2005, "F-1"), ("ford", "FOCUS", 2003, 2008, "F-2"), ("Ford", "Focus", 2010, 2015, "F-3"), ("Opel", "Astra", 2000, 2002, "O-1")]


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame(APPS, "make string, model string, year_from int, year_to int, code string")


def ask(spark, *wanted):
    return spark.createDataFrame(list(wanted), "make string, model string, year int")


def test_lookups(spark, apps):
    r = ask(spark, ("FORD", "focus", 2004), ("Ford", "Focus", 2009), ("Opel", "Astra", 1990), ("Fiat", "Uno", 1990))
    assert rows(lookup.exact(r, apps)) == [("FORD", "focus", 2004, 2000, 2005, "F-1")]  # equal widths: the earlier one
    near = {(x["make"], x["year"]): (x["code"], x["covered"]) for x in lookup.nearest(r, apps).collect()}
    assert near == {("FORD", 2004): ("F-2", True), ("Ford", 2009): ("F-3", False), ("Opel", 1990): ("O-1", False)}


@pytest.mark.parametrize("published, expected", [(["F-1"], ("F-1", 1)), (["F-2"], ("F-2", 2)), (["F-3"], ("F-3", 2)), ([], ("F-1", 3)), (["O-1"], ("F-1", 3))])
def test_tiers_rank_first_and_test_after(spark, apps, published, expected):
    p = spark.createDataFrame([(c,) for c in published], "code string")
    got = lookup.tiered(ask(spark, ("Ford", "Focus", 2004)), apps, p).first()
    assert (got["code"], got["tier"]) == expected
    far = lookup.tiered(ask(spark, ("Ford", "Focus", 2020)), apps, spark.createDataFrame([], "code string")).first()
    assert (far["code"], far["tier"]) == ("F-3", 6)


@pytest.mark.parametrize("published, expected", [(["F-1"], ("F-1", 4)), (["F-3"], ("F-3", 5)), ([], ("F-1", 6)), (["R-1"], ("R-1", 2))])
def test_tiers_of_display_names(spark, published, expected):
    rows_ = [("Ford", "F0cus", 2000, 2005, "F-1", "Focus"), ("Ford", "Fokus", 2010, 2015, "F-3", "Focus")]
    rows_ += [("Ford", "Focus", 1980, 1981, "R-1", "Focus")] if published == ["R-1"] else []
    apps = spark.createDataFrame(rows_, "make string, model string, year_from int, year_to int, code string, display string")
    p = spark.createDataFrame([(c,) for c in published], "code string")
    got = lookup.tiered(ask(spark, ("Ford", "focus", 2004)), apps, p, "display").first()
    assert (got["code"], got["tier"]) == expected


def test_representative_and_intervals(spark, apps):
    extra = apps.unionByName(spark.createDataFrame([("Ford", "Ka", 2000, 2009, "F-1")], apps.schema))
    assert [r["model"] for r in lookup.representative(extra).filter("code = 'F-1'").collect()] == ["Ka"]
    points = spark.createDataFrame([(2,), (3,)], "p int")
    spans = spark.createDataFrame([("a", 1, 2), ("b", 3, 2)], "n string, s int, e int")
    assert rows(lookup.interval_members(spans, "s", "e", points, "p").select("n", "p")) == [("a", 2)]
    assert rows(lookup.optional_filter(spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, k string"), k="x", j="")) == [(1, "x"), (2, None)]


def test_upserts_twice_is_once(spark):
    s = "k int, v string, at int"
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], s), spark.createDataFrame([(1, "c", 2), (2, "d", 5), (3, "e", 0)], s)
    once = relational.upsert(old, new, ["k"], "at")
    assert rows(once) == [(1, "c", 2), (2, "d", 5), (3, "e", 0)] == rows(relational.upsert(once, new, ["k"], "at"))
    folded = relational.upsert_folded(spark.createDataFrame([("Ford", 1, "x", 1), ("FORD", 1, "y", 2)], "make string, code int, note string, at int"), ["make"], ["code"], "at")
    assert rows(folded.select("make", "code", "note")) == [("Ford", 1, "y")]


def test_guarded_upsert(spark):
    s = "k int, verified boolean, score long, side string"
    old = spark.createDataFrame([(1, True, 0, "o"), (2, False, 9, "o"), (3, False, 8, "o"), (4, True, 0, "o"), (5, False, 0, "o")], s)
    new = spark.createDataFrame([(1, False, 99, "n"), (2, False, 4, "n"), (3, False, 4, "n"), (4, True, 0, "n"), (6, False, 0, "n")], s)
    got = {r["k"]: r["side"] for r in relational.upsert_guarded(old, new, "k", "verified", "score").collect()}
    assert got == {1: "o", 2: "o", 3: "n", 4: "n", 5: "o", 6: "n"}


def test_deletes_and_groups(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, d string")
    assert rows(relational.delete_where(t, F.col("d") == "a")) == [(2, None), (3, "b")]
    assert rows(relational.replace_group(t, t.limit(0), ["k"])) == rows(t)
    assert rows(relational.insert_missing(t, spark.createDataFrame([(1, "z"), (9, "z")], t.schema), ["k"])) == [(1, "a"), (2, None), (3, "b"), (9, "z")]
    parents, children = relational.retract(t, spark.createDataFrame([(1, "x"), (3, "y")], "k int, c string"), "k", t.filter("k = 1"), "gone")
    assert rows(parents.select("k", "gone")) == [(1, True), (2, False), (3, False)] and rows(children) == [(3, "y")]


def test_monotone_run_and_bands(spark):
    df = spark.createDataFrame([(1, [5, 1, 9, 8, 7, 2]), (2, [1, 2, 3]), (3, [3])], "i int, v array<int>")
    assert {r["i"]: r["r"] for r in df.select("i", relational.monotone_run(F.col("v"), 3).alias("r")).collect()} == {1: [9, 8, 7], 2: None, 3: None}
    cells = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 1, 1, 0, 1, 0, 0, 1, 0])], "g string, p int, v double")
    assert rows(relational.density_bands(cells, ["g"], "p", F.col("v"), 1.0, 3, 1)) == [("a", 1, 5)]


def test_budget(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, i) for i in range(10)], "k int, cached boolean, size int")
    got = relational.budgeted_by_key(df, "k", ~F.col("cached"), [F.desc("size")], 2)
    assert {r["k"]: r["status"] for r in got.collect()} == {i: "cached" if i % 3 == 0 else "run" if i in (8, 7) else "waiting" for i in range(10)}


# -- sections: one case for each rule --------------------------------------------------------

COVER = "CODES STYLE CARD MACS 2001-05 "


@pytest.mark.parametrize(
    "pages, expected",
    [
        (["AB-1 SECTION x", "more", "AB-2 SECTION"], [("AB-1", 1, 2, False), ("AB-2", 3, 3, False)]),  # 1, 6, 7
        (["AB-1 SECTION", "TABLE OF CONTENTS", "after"], [("AB-1", 1, 1, False)]),  # 2: boundary closes
        (["AB-1 SECTION", "TABLE OF CONTENTS SPACING DEPTHS"], [("AB-1", 1, 2, False)]),  # 2: technical pages go on
        (["AB-1 SECTION", "lost heading", "continued AB-7 SECTION"], [("AB-1", 1, 1, False), ("AB-7", 2, 3, False)]),  # 3
        (["AB-1 SECTION", COVER, "tail"], [("AB-1", 1, 1, False), ("AB-2", 2, 3, False)]),  # 4a
        (["AB-1 SECTION", "??.9 SECTION"], [("AB-1", 1, 1, False), ("AB-9", 2, 2, False)]),  # 4b
        (["AB-1 SECTION", "? SECTION ?"], [("AB-1", 1, 1, False), ("AB-2", 2, 2, False)]),  # 4c
        (["AB-1 SECTION", COVER, COVER], [("AB-1", 1, 1, False), ("AB-2", 2, 2, False), ("AB-3", 3, 3, False)]),  # inferred from inferred
        (["AB-1 SECTION", "AB-1 SECTION again"], [("AB-1", 1, 2, False)]),  # 5: same code
        (["front", "AB-1 SECTION continued"], [("AB-1", 1, 2, True)]),  # 5: page before belongs to it
        (["before any section"], []),  # 6
        ([], []),
    ],
)
def test_section_rules(spark, pages, expected):
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(pages)], "document string, page_number int, text string")
    got = sections.split_sections(sections.page_features(df)).orderBy("page_start", "code").collect()
    assert [(r["code"], r["page_start"], r["page_end"], r["first_page_shared"]) for r in got] == expected


def test_section_texts_overlap_by_a_page(spark):
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(["AB-1 SECTION", "plain", "AB-2 SECTION\ncontinued " + "x" * 200])], "document string, page_number int, text string")
    s = sections.split_sections(sections.page_features(df))
    got = {r["code"]: r["raw_text"] for r in sections.section_texts(s, df).collect()}
    assert got["AB-2"].startswith("plain\nAB-2") or got["AB-1"].endswith("plain")


# -- geometry --------------------------------------------------------------------------------


def test_rows_cluster_with_a_moving_middle():
    page = pd.DataFrame({"mid_y": [100.0, 117.0, 136.0, 155.5], "left": [0, 1, 2, 3]})
    assert geometry.assign_rows(page)["row_no"].tolist() == [0, 0, 1, 2]
    assert geometry.assign_rows(pd.DataFrame({"mid_y": [0.0, 18.0], "left": [0, 0]}))["row_no"].tolist() == [0, 0]
    assert geometry.assign_rows(pd.DataFrame({"mid_y": [0.0, 19.0], "left": [0, 0]}))["row_no"].tolist() == [0, 1]


def test_component_boxes():
    grid = np.zeros((8, 8), bool)
    grid[0, 0:3] = grid[1, 2] = grid[5, 5] = grid[6, 6] = True
    assert geometry.component_boxes(grid, 1) == [(0, 0, 3, 2), (5, 5, 6, 6), (6, 6, 7, 7)]
    assert geometry.component_boxes(grid, 2) == [(0, 0, 3, 2)]
    assert geometry.merge_boxes([(0, 0, 2, 2), (3, 0, 4, 2), (7, 7, 8, 8)], (8, 8), 0, 1) == [(0, 0, 4, 2), (7, 7, 8, 8)]
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1, 8] = snake[3, 0] = snake[5, 8] = snake[7, 0] = True
    assert geometry.component_boxes(snake, 1) == [(0, 0, 9, 9)]


def test_progression():
    assert geometry.expected_rows([900, 875, 851, 300], 25) == [900 - 25 * i for i in range(8)]
    assert geometry.expected_rows([900, 700], 25) is None and geometry.expected_rows([900, 875, 850], 0) is None


def test_column_edges(spark):
    got = [r["c"] for r in spark.createDataFrame([(0.22,), (0.48,), (0.98,), (0.1,)], "x double").select(lookup.column_of(F.col("x"), geometry.TOC_COLUMNS).alias("c")).collect()]
    assert got == ["model", "years", None, None]


# -- search, gates ---------------------------------------------------------------------------


def test_search(spark):
    df = spark.createDataFrame([(1, "Ford Focus keys 2004"), (2, "ford  fo-cus"), (3, "nothing"), (4, None)], "i int, t string")
    got = search.term_search(df, "t", ["Ford", "Focus", "2004"], ["i"]).collect()
    assert [(r["i"], r["score"]) for r in got] == [(1, 3), (2, 2)]
    long = spark.createDataFrame([("a" * 200 + " hit " + "b" * 300,)], "t string").select(search.snippet("t", ["HIT"]).alias("s")).first()["s"]
    assert long.startswith("...") and long.endswith("...") and len(long) == 306 and " hit " in long


@pytest.mark.parametrize("published, verified, bad, expected", [(True, True, 0, "published"), (True, False, 0, "awaiting_verification"), (False, True, 1, "rejected"), (False, False, 0, "needs_review"), (None, None, 0, "needs_review"), (True, None, 1, "rejected")])
def test_status(spark, published, verified, bad, expected):
    df = spark.createDataFrame([(published, verified, ["x"] * bad)], "p boolean, v boolean, i array<string>")
    assert df.select(gates.status(F.col("p"), F.col("v"), F.col("i")).alias("s")).first()["s"] == expected


def test_publishable(spark):
    df = spark.createDataFrame([("AB-1", [], 1), ("ab-1", [], 1), ("AB-1", ["x"], 1), ("AB-1", [], 0), (None, [], 1)], "c string, i array<string>, n int")
    got = [r["v"] for r in df.select(gates.publishable(F.col("c"), F.col("i"), F.col("n"), [F.lit(True), F.lit(None).cast("boolean"), F.lit(True)]).alias("v")).collect()]
    assert got == [True, False, False, False, False]


def test_stale_jobs(spark):
    log = spark.createDataFrame([("a", "2024-01-01 00:00:00", "running"), ("b", "2024-01-01 02:00:00", "running"), ("c", "2024-01-01 00:00:00", "running"), ("c", "2024-01-01 01:00:00", "done")], "job string, at string, state string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["job"]: r["last_state"] for r in gates.latest_jobs(log, "2024-01-01 13:00:00").collect()}
    assert got == {"a": "interrupted", "b": "running", "c": "done"}
    assert gates.keep_latest(log, ["job"], "at", 1).count() == 3


def test_cache(spark):
    work = spark.createDataFrame([("m", "t1"), ("m", "t2")], "model string, text string")
    keys = gates.cache_misses(work, spark.createDataFrame([], "cache_key string"), ["model", "text"], "v1")
    known = keys.filter("text = 't1'").select("cache_key")
    assert [r["text"] for r in gates.cache_misses(work, known, ["model", "text"], "v1").collect()] == ["t2"]
    assert gates.cache_misses(work, known, ["model", "text"], "v2").count() == 2


# -- sources, streams ------------------------------------------------------------------------


def test_json_sources(spark, tmp_path):
    page = {"page_number": 1, "ocr_text": "x"}
    (tmp_path / "pages.json").write_text(json.dumps([{"name": "d", "pages": [page]}, {"name": "gone", "missing": True, "pages": [page]}]))
    assert [(r["document"], r["page_number"], r["ocr_text"]) for r in files.pages(spark, str(tmp_path / "pages.json")).collect()] == [("d", 1, "x")]
    assert files.pages(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    seed = spark.createDataFrame([("s",)], "a string")
    assert files.read_json(spark, str(tmp_path / "bad.json"), "a string").count() == 0
    assert rows(files.read_json(spark, str(tmp_path / "bad.json"), "a string", seed)) == [("s",)]
    (tmp_path / "c.json").write_text(json.dumps({"vehicle_applications": [{"make": "Ford", "year_from": 1}], "sections": [{"code": "A-1"}]}))
    assert files.applications(spark, str(tmp_path / "c.json")).first()["make"] == "Ford"
    assert files.sections(spark, str(tmp_path / "c.json")).first()["code"] == "A-1"


def test_word_table_and_files(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    lines = [head, "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90.5\tok", "5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t-1\tno", "5\t1\t1\t1\t1\t3\t0\t0\t9\t9\tx\tno", "5\t1\t1\t1\t1\t4\t0\t0\t9\t9\t80\t "]
    (tmp_path / "w.tsv").write_text("\n".join(lines))
    assert [(r["text"], r["confidence"]) for r in files.words(spark, str(tmp_path / "w.tsv")).collect()] == [("ok", 90.5)]
    found = files.listing(spark, str(tmp_path), "*.tsv")
    assert found.count() == 1 and found.first()["length"] == len("\n".join(lines))


def test_insert_script_and_replacement(spark):
    df = spark.createDataFrame([("O'x", 1, ["a'b"]), (None, None, [])], "n string, k int, t array<string>")
    assert [r["statement"] for r in files.insert_script(df, "t").collect()] == ["INSERT INTO t (n, k, t) VALUES ('O''x', 1, ARRAY['a''b']);", "INSERT INTO t (n, k, t) VALUES (NULL, NULL, ARRAY[]);"]
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "document string, p int")
    assert rows(files.replace_document(a, spark.createDataFrame([("d2", 9)], a.schema))) == [("d1", 1), ("d2", 9)]


def test_incremental_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, f"v{i}", i) for i in range(40)], "k int, v string, at int")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), df.schema)
    incremental.run_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at")
    assert rows(incremental.current(spark, str(tmp_path / "out"))) == rows(relational.upsert(df.limit(0), df, ["k"], "at"))
    incremental.run_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at")
    assert incremental.current(spark, str(tmp_path / "out")).count() == 5


def test_windows_of_a_stream_equal_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = incremental.file_stream(spark, str(tmp_path / "e"), events.schema)
    q = incremental.tumbling(stream, "1 day").writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"], 4)) for r in d.collect())
    assert key(spark.table("tumble")) == key(incremental.tumbling(events, "1 day"))


@pytest.mark.parametrize("page", ["Passlock", "VATS", "Misc Info - Lexus", "National Auto Lock Service", "Toyota code series M.A.C.S.", "Acura Hon da transponder information", "On-board transponder programming", "ТАЫЕ of contents"])
def test_boundary_pages_end_a_section(spark, page):
    df = spark.createDataFrame([("d", 1, "AB-1 SECTION"), ("d", 2, page), ("d", 3, "after")], "document string, page_number int, text string")
    assert [(r["page_start"], r["page_end"]) for r in sections.split_sections(sections.page_features(df)).collect()] == [(1, 1)]


def test_rebuilt_rows_equal_the_loop(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.randint(100, 1300) for _ in range(r.randint(0, 6))] + [900 - 25 * k + r.randint(-5, 5) for k in range(r.randint(0, 8))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, anchors array<int>")
    for step in (25, 0, 90):
        got = {x["id"]: x["row"] for x in geometry.rebuilt_rows(df, "anchors", step).collect()}
        assert got == {i: geometry.expected_rows(v or [], step) for i, v in rows}


def test_row_columns_can_be_written(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 40.0, 30.0, "a", 90.0, 100.0), (1, 0, 10.0, 10.0, "b", 70.0, 100.0)], "page long, row_no long, left double, mid_x double, text string, confidence double, page_width double")
    out = geometry.row_columns(words, "page", "page_width")
    out.write.parquet(f"{tmp_path}/rows")
    assert len(set(out.columns)) == len(out.columns) and spark.read.parquet(f"{tmp_path}/rows").count() == 1


def test_a_broken_pointer_stops_an_upsert(spark, tmp_path):
    """Only a missing pointer table means an empty target: a damaged one must not lose the rows before."""
    import os

    import pytest as pt

    schema = "k long, v long"
    for part, rows in enumerate([[(1, 1)], [(2, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part:
            for f in os.listdir(f"{tmp_path}/t/_current"):
                if f.endswith(".parquet"):
                    with open(f"{tmp_path}/t/_current/{f}", "wb") as out:
                        out.write(b"damaged")
                    os.path.exists(f"{tmp_path}/t/_current/.{f}.crc") and os.remove(f"{tmp_path}/t/_current/.{f}.crc")
            with pt.raises(Exception, match="(?i)upsert|parquet|exception"):
                incremental.run_upserts(incremental.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/t", f"{tmp_path}/c", ["k"], "v")
        else:
            incremental.run_upserts(incremental.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/t", f"{tmp_path}/c", ["k"], "v")
            assert incremental.current(spark, f"{tmp_path}/t").count() == 1


def test_latest_entries_have_a_total_order(spark):
    rows = [(1, 5, x) for x in "dacb"]
    for order in (rows, rows[::-1]):
        kept = gates.keep_latest(spark.createDataFrame(order, "g long, at long, name string"), ["g"], "at", 2).collect()
        assert sorted(r["name"] for r in kept) == ["c", "d"]
