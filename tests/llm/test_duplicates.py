import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import common, components, line_dedup, ngram_join, substring_dedup
from quirework.llm.suffix_array import suffix_array

from .cases import edge_docs, edge_rows, empty_docs, prose


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# -- suffix arrays and repeated strings ------------------------------------------------------


def test_suffix_array_against_sorting():
    r = np.random.default_rng(0)
    for k in range(600):
        a = r.integers(0, r.integers(1, 5), r.integers(0, 40)) * (10**9 if k % 7 == 0 else 1)
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def brute_repeats(rows, length):
    seen = collections.Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((d, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def repeats(df, length):
    return sorted(repr(tuple(r)) for r in substring_dedup.remove_repeats(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_repeats_edges(spark):
    assert repeats(edge_docs(spark), 100) == brute_repeats(edge_rows(), 100)
    out = substring_dedup.remove_repeats(edge_docs(spark), 100)
    assert set(edge_docs(spark).columns) < set(out.columns)
    assert repeats(empty_docs(spark), 100) == []


@pytest.mark.parametrize("crowded", [3, 256])
def test_repeats_around_a_shared_passage(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    r = random.Random(3)
    w = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p = w(700)
    rows = [(i, w(r.randint(0, 500)) + p[r.randint(0, 200) : r.randint(450, 700)] + w(r.randint(0, 500))) for i in range(40)]
    assert repeats(table(spark, rows), 400) == brute_repeats(rows, 400)


def test_long_texts_are_read_in_steps(monkeypatch):
    raw = prose(8, 2000).encode()
    whole = substring_dedup.stretches(raw, 100)
    monkeypatch.setattr(substring_dedup, "POSITION_BITS", 10)
    stepped = substring_dedup.stretches(raw, 100)
    assert sum(whole[1]) == sum(stepped[1]) == len(raw) - 99


def test_repeats_on_the_table(spark, small):
    docs = common.read_table(spark, small, "documents").select("doc_id", "text")
    assert repeats(docs, 400) == brute_repeats([tuple(r) for r in docs.collect()], 400)


# -- shingle sets ----------------------------------------------------------------------------


def brute_components(rows, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update([b" ".join(w)] if 0 < len(w) < 5 else [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common_ = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d) if d is not None else None) for d in sets}


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df).collect()}


def test_components_edges(spark):
    assert joined(edge_docs(spark)) == brute_components(edge_rows())
    assert ngram_join.link_components(edge_docs(spark)).count() == len(edge_rows())
    assert joined(empty_docs(spark)) == {}


def test_components_of_chains_hot_lines_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_TOTAL", 6)
    monkeypatch.setattr(ngram_join, "LEADER_ENTRIES", 4)
    r = random.Random(2)
    line, base = prose(50, 25), prose(51, 90).split(" ")
    rows = [(i, prose(100 + i, r.randint(3, 60)) + " " + line) for i in range(25)]
    for i in range(40):  # near copies, some linked only through others
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(words)))
    chain = prose(52, 100).split(" ")
    for i in range(12):
        rows.append((200 + i, " ".join(chain[2 * i : 2 * i + 60])))
    assert joined(table(spark, rows)) == brute_components(rows)


def test_components_on_the_table(spark, small):
    docs = common.read_table(spark, small, "documents").select("doc_id", "text")
    assert joined(docs) == brute_components([tuple(r) for r in docs.collect()])


def test_keep_one(spark):
    kept = ngram_join.keep_one(edge_docs(spark))
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    gone = {d for d, (_, c) in brute_components(edge_rows()).items() if d is not None and c != d}
    assert ids == sorted(-1 if d is None else d for d, _ in edge_rows() if d not in gone)
    assert kept.columns == edge_docs(spark).columns


def test_component_labels(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- lines -----------------------------------------------------------------------------------


def brute_runs(rows):
    """Lines outside every run of enough lines or words that occurs at an earlier place."""
    docs = sorted({(d, tuple(x.strip() for x in (t or "").split("\n") if x.strip())) for d, t in rows}, key=lambda k: (k[0] is not None, k[0] or 0))
    seen, out = set(), {}
    for d, lines in docs:
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = lines[i:j]
                if j - i >= line_dedup.MIN_LINES or sum(x.count(" ") + 1 for x in run) >= line_dedup.MIN_WORDS:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out[d] = [x for i, x in enumerate(lines) if i not in gone]
    return out


def kept_lines(df):
    return {r["doc_id"]: [x.strip() for x in (r["text"] or "").split("\n") if x.strip()] for r in line_dedup.dedup_lines(df).collect()}


def test_lines_edges(spark):
    assert kept_lines(edge_docs(spark)) == brute_runs(edge_rows())
    out = line_dedup.dedup_lines(edge_docs(spark))
    assert out.columns == [*edge_docs(spark).columns, "n_lines", "n_removed", "n_runs"]
    assert {r["doc_id"]: r["text"] for r in out.collect()}[3] is None
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_lines_on_the_table(spark, small):
    docs = common.read_table(spark, small, "documents").select("doc_id", "text")
    assert kept_lines(docs) == brute_runs([tuple(r) for r in docs.collect()])


def test_a_long_line_goes_from_later_places_alone(spark):
    passage = prose(77, 60).replace("\n", " ")
    rows = [(i, f"{prose(80 + i, 12)}\n{passage}\n{prose(90 + i, 12)}") for i in range(3)]
    got = kept_lines(table(spark, rows))
    assert [" ".join(passage.split(" ")).strip() in x for x in (got[0], got[1], got[2])] == [True, False, False]
    assert len(got[1]) == len([x for x in rows[1][1].split("\n") if x.strip()]) - 1


def test_two_lines_with_enough_words_go_from_later_places(spark):
    r = random.Random(5)
    line = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    rows = []
    for i in range(40):
        shared = [line(30), line(30)]
        rows += [(2 * i + k, "\n".join([line(5), line(5), *shared, line(5), line(5)])) for k in (0, 1)]
    got = kept_lines(table(spark, rows))
    assert [len(got[d]) for d, _ in rows] == [6, 4] * 40


def test_all_repeated_runs_go_also_around_frequent_lines(spark):
    r = random.Random(6)
    frequent = ["Les.", "All rights reserved.", " ".join(["long"] * 30), " ".join(["longest"] * 55)]
    passages = [[f"p{k} line {i}" for i in range(r.randint(2, 6))] for k in range(12)]
    rows = [(None, "\n".join(passages[0]))]
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            lines += r.choice(passages)[r.randint(0, 1) :]
            lines += r.choice([[], [r.choice(frequent)], [f"own {d} {r.random()}"], ["", "  "]])
        rows.append((d, "\n".join(lines)))
    rows.append(rows[-1])
    assert kept_lines(table(spark, rows)) == brute_runs(rows)
    one = ["first of three", "All rights reserved.", "third of three"]
    rows = [(0, "a\nAll rights reserved.\nb"), (1, "\n".join(["c", *one, "d"])), (2, "\n".join(["e", *one, "f"]))]
    assert kept_lines(table(spark, rows))[2] == ["e", "f"]


def test_every_window_holds_a_chosen_line():
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4, 50):
        h = r.integers(0, 6, n).astype(np.uint64)
        chosen = line_dedup.window_minima(h)
        assert len(chosen) == max(0, n - 2)
        for i, p in enumerate(chosen.tolist()):
            assert i <= p <= i + 2 and h[p] == h[i : i + 3].min() and not (h[p + 1 : i + 3] == h[p]).any()


def test_winnowing_drops_most_lines_that_occur_once(spark):
    """Marks are fewer than lines, and what travels to the second join are marks that some other place shares."""
    rows = [(i, "\n".join(f"own {i} {k}" for k in range(40))) for i in range(20)]
    rows += [(100, rows[0][1]), (101, "\n".join(["x", *rows[1][1].split("\n")[5:15], "y"]))]
    marks = line_dedup.marks(table(spark, rows)).withColumn("print", F.element_at("around", 3))
    assert marks.count() < 0.75 * sum(len(t.split("\n")) for _, t in rows)
    shared = marks.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1")
    met = marks.join(shared, "print").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in met} == {0, 1, 100, 101}


def test_matches_grow_along_their_diagonal(spark):
    """A copied passage of many lines comes back as one run, a second copy behind it as another."""
    own = lambda k: [f"own {k} {i}" for i in range(4)]
    passage = [f"shared line {i}" for i in range(25)]
    rows = [(1, "\n".join([*own(1), *passage])), (2, "\n".join([*own(2), *passage, *own(3), *passage[5:9]]))]
    got = line_dedup.repeated_runs(table(spark, rows)).collect()
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]]) for r in got] == [(2, [(4, 28), (33, 36)])]


def test_runs_leave_columns_of_any_name(spark):
    shared = "one line\nanother line\na third line"
    rows = [(1, f"{shared}\nown", 5, "a", 7), (2, shared, 5, "b", 7), (3, f"{shared}\nmine", 5, "c", 7), (4, None, 5, "d", 7), (5, " \n", 5, "e", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, n_runs string, n_chars long")
    out = line_dedup.without_repeats(docs, "n_chars")
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()))
    assert got == [rows[0], (3, "mine", 5, "c", 4), rows[3], rows[4]]


def boilerplate(n, own=12, shared=96):
    """Documents of own words and one long shared text: alike, but not enough to link."""
    common_text = " ".join(f"licence{k}" for k in range(shared))
    return [(i, " ".join(f"own{i}x{k}" for k in range(own + i % 3)) + " " + common_text) for i in range(n)]


def test_shared_boilerplate_makes_no_pairs(spark, monkeypatch):
    """The last step meets sets by what they can reach together, so a frequent passage alone pairs nobody."""
    met = []
    whole = ngram_join._meetings

    def counted(marked, percent):
        met.append((marked.count(), ngram_join._prospects(marked, percent).count()))
        return whole(marked, percent)

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    rows = boilerplate(600) + [(1000, "quite " + boilerplate(1)[0][1]), (1001, boilerplate(3)[2][1] + " more")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(table(spark, rows)).collect()}
    assert got == {**{i: i for i in range(600)}, 1000: 0, 1001: 2}
    entries, prospects = met[0]
    assert entries > 1000 and prospects < 100


def test_partners_of_every_size_are_met(spark):
    """Sets at the very border of the bound, of all sizes, against brute force."""
    r = random.Random(9)
    rows, words = [], [f"w{k}" for k in range(400)]
    for g in range(12):
        base = r.sample(words, r.randint(15, 120))
        for k in range(8):
            cut = r.randint(0, max(1, len(base) // 5))
            rows.append((g * 100 + k, " ".join((base[cut:] if k % 2 else base[: len(base) - cut]) + [f"x{g}y{k}z{j}" for j in range(r.randint(0, 3))])))
    assert joined(table(spark, rows)) == brute_components(rows)


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b = prose(31, 50), prose(32, 50)
    rows = [(1, a), (2, a), (2, b), (3, b)]
    kept = sorted(tuple(r) for r in ngram_join.keep_one(table(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, b)])


def test_size_classes_and_their_bounds(spark):
    sizes = [*range(1, 700), 5000, 123_456]
    got = [r["c"] for r in spark.createDataFrame([(n,) for n in sizes], "n int").select(ngram_join._class_of("n").alias("c")).collect()]
    assert got == [ngram_join.size_class(n) for n in sizes] == sorted(got)
    over = lambda a, b: -(-80 * (a + b) // 180)
    need = lambda n, m: over(n, m) - -(-80 * n // 100) + 1
    for n in [*range(1, 300, 7), 999, 2048]:
        aims, lasts, leasts = (x.tolist() for x in ngram_join._bounds(n, 80))
        for m in range(n, n * 100 // 80 + 1):
            k = -(-min(need(n, m), need(m, n)) // 2)
            i = aims.index(ngram_join.size_class(m))
            assert lasts[i] >= n - over(n, m) + k - 1 and leasts[i] <= max(1, k)
