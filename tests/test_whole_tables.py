"""The queries over every row against plain Python."""

import html
import re

import pytest

from quirework.functions import text
from quirework.operators import relational
from quirework.plans import catalog

LETTERS = re.compile("[A-Za-z]")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts of several languages, with blanks at their ends, blank lines, empty and null."""
    out = str(tmp_path_factory.mktemp("whole"))
    texts = ["Remote key 315 MHz", " \n\tLa version de la license \n", "Das ist ein langer Satz ohne besondere Zeichen\nkurz", "Größe über alles, ein ziemlich langer Satz mit Zeichen", "one\n\n\ntwo & three \n\n \n\nfour", "", None, "x" * 90]
    langs = ["en", "fr", "de", "de", "es", "en", "fr", "en"]
    spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([texts[0], "short", "Another scanned text that is longer than forty characters", None])], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{out}/conversations.parquet")
    return out, texts


def points(t):
    t = t or ""
    terms = r"(?i)\b(?:" + "|".join(text.DOMAIN_TERMS) + r")\b"
    n = lambda p: len(re.findall(p, t))
    return 100 * n("[A-Za-z]") + 15 * n(" ") + 1200 * n(terms) - 800 * n("[^\x00-\x7f]") - 500 * n(r"[±¤\[\]{}]|[A-Za-z][0-9][A-Za-z]")


def chosen(a, b):
    a, b = a or "", b or ""
    if 100 * points(a) >= 85 * points(b) and len(a) > 80:
        return "native"
    if points(b) >= points(a) and len(b) > 40:
        return "native" if a == b else "scan"
    return "native" if a or not b else "scan"


def meaningful(x):
    return 28 <= len(x) <= 520 and x.count(" ") >= 3 and x.isascii() and 100 * len(LETTERS.findall(x)) >= 42 * len(x)


def rows(spark, folder, name):
    return {r[0]: r[-1] for r in catalog.QUERIES[name](spark, folder).collect()}


def test_every_text_has_a_result(spark, folder):
    at, texts = folder
    assert rows(spark, at, "text_quality_score_whole") == {i: points(t) for i, t in enumerate(texts)}
    assert rows(spark, at, "meaningful_lines_whole") == {i: sum(meaningful(x) for x in (t or "").split("\n")) for i, t in enumerate(texts)}
    squeezed = lambda t: t if t is None else re.sub("(?i)version", "release", re.sub("(?i)license", "permit", " ".join(t.split())))
    assert rows(spark, at, "rewrite_rules_whole") == {i: squeezed(t) for i, t in enumerate(texts)}
    parts = lambda t: "".join(f"<p>{html.escape(p.strip())}</p>" for p in (t or "").split("\n\n") if p.strip())
    assert rows(spark, at, "markdown_light_whole") == {i: parts(t) for i, t in enumerate(texts)}
    others = {i: r[1] for i, r in enumerate(sorted(spark.read.parquet(f"{at}/benchmark.parquet").collect()))}
    assert rows(spark, at, "choose_best_text_whole") == {i: chosen(t, others[i % len(others)]) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", ["1", "5"])
def test_every_row_has_a_place(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    df = spark.createDataFrame([(i, i * 37 % 11) for i in range(300)], "k long, v long")
    got = {r["k"]: r["place"] for r in relational.places(df, ["v", "k"], "place").collect()}
    empty = relational.places(df.limit(0), ["v", "k"], "place").count()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: p for p, (_, k) in enumerate(sorted((i * 37 % 11, i) for i in range(300)), 1)} and empty == 0


def test_canonical_names_of_the_whole_table(spark, small):
    """Every part's word against the vocabulary, by the ratio of the standard library."""
    from difflib import SequenceMatcher

    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    expected = {}
    for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_type").collect():
        word, best = r["p_type"].split(" ")[0], (0.0, r["p_type"].split(" ")[0])
        for v in catalog.VOCABULARY:
            a, b = plain(word), plain(v)
            score = SequenceMatcher(None, a, b).ratio()
            if a in b or b in a:
                score = max(score, 0.9)
            if score > best[0]:
                best = (score, v)
        expected[r["p_partkey"]] = (best[1] if best[0] >= 0.78 else word, round(best[0], 6))
    assert {r["p_partkey"]: (r["canonical"], r["score"]) for r in catalog.QUERIES["canonicalize"](spark, small).collect()} == expected


def test_rows_of_words_of_the_whole_table(spark, small):
    """Words top down, each into the first row whose middle is within 18 of its own; the middle then moves half-way."""
    expected = {}
    pages = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        for i, _ in enumerate(r["text"].split(" ")):
            pages.setdefault(r["conv_id"], []).append((r["turn"] * 60 + i % 5 * 9 + 5.0, i * 37 % 900))
    for page, words in pages.items():
        found = []
        for y, _ in sorted(words):
            for row in found:
                if abs(y - row[0]) <= 18:
                    row[0], row[1] = (row[0] + y) / 2, row[1] + [y]
                    break
            else:
                found.append([y, [y]])
        for k, (_, ys) in enumerate(found):
            expected[page, k] = (len(ys), sum(ys) / len(ys))
    got = {(r["page"], r["row_no"]): (r["n"], r["middle"]) for r in catalog.QUERIES["row_clustering"](spark, small).collect()}
    assert got.keys() == expected.keys() and all(got[k][0] == n and abs(got[k][1] - m) < 1e-3 for k, (n, m) in expected.items())


def test_boxes_of_the_whole_table(spark, small):
    """Areas by a flood fill from every cell, in reading order; touching ones joined."""
    expected = set()
    for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect():
        cells = {(i // 8, i % 8) for i, v in enumerate(r["embedding"]) if v >= 0.1}
        boxes, seen = [], set()
        for start in sorted(cells):
            if start in seen:
                continue
            area, todo = set(), [start]
            while todo:
                y, x = todo.pop()
                if (y, x) in cells and (y, x) not in area:
                    area.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            seen |= area
            if len(area) >= 2:
                ys, xs = zip(*area, strict=True)
                boxes.append([min(xs), min(ys), max(xs) + 1, max(ys) + 1])
        joined = []
        for b in sorted(boxes, key=lambda b: (b[1], b[0])):
            for m in joined:
                if b[0] <= m[2] and m[0] <= b[2] and b[1] <= m[3] and m[1] <= b[3]:
                    m[:] = [min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3])]
                    break
            else:
                joined.append(list(b))
        expected |= {(r["vec_id"], i, *b) for i, b in enumerate(joined)}
    assert {tuple(r) for r in catalog.QUERIES["connected_boxes"](spark, small).collect()} == expected


def test_progression_rounds_as_its_sql(spark, tmp_path):
    """Values whose 3000-fold is a half as a single, and just below one as a double."""
    import duckdb

    values = [[v, v - 0.008333, v - 0.016667, 0.5] for v in (0.2434999942779541, 0.2331666648387909, 0.2434, -0.25)]
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.execute(catalog.ORACLE_SQL["progression_rebuild"]).fetchall())
    assert expected and sorted(tuple(r) for r in catalog.QUERIES["progression_rebuild"](spark, str(tmp_path)).collect()) == expected
