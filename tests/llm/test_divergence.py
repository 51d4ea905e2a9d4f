import random
import re

import numpy as np
import pytest

from quirework.llm import divergence

from .cases import edge_docs, empty_docs


def brute(rows: list[tuple], least: int = 3, most: int = 200) -> list[tuple]:
    """The whole definition in Python integers."""
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        kept = sorted({t for r in mine for t in r[2] if sum(t in x[2] for x in mine) >= least}, key=lambda t: t.encode())

        def shares(rows):
            n = {t: 0 for t in kept}
            for r in rows:
                for t in r[2]:
                    if t in n:
                        n[t] += 1
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        sources = {r[1] for r in mine}
        each = {s: shares([r for r in mine if r[1] == s]) for s in sources}
        whole = shares(mine)[1]
        for s in sources:
            n, p = each[s]
            pairs = [(o, sum((p[t] - q) ** 2 // q for t, q in each[o][1].items())) for o in sources if o != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if n[t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < most]
    return sorted(out)


def table(seed: int, n: int, sources: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [("en", "hot" if r.random() < 0.4 else f"s{r.randint(0, sources)}", " ".join(r.choice(["The", "é", "b", "𝒳x", "ﬀ", "Zz1y", f"w{chr(97 + r.randint(0, 25))}"]) for _ in range(r.randint(0, 30)))) for _ in range(n)]
    rows += [(None, None, "a b c"), (None, "x", None), ("de", "only", "eins eins eins"), ("fr", "a", ""), ("fr", "b", "12 -"), ("es", "a", "uno dos"), ("es", "b", "uno"), ("es", "a", "Uno"), ("es", "c", None)]
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(1, *r, 9) for r in rows], "value int, lang string, source string, text string, term int")
    return sorted(tuple(r) for r in divergence.audit(docs, **kw).collect())


@pytest.mark.parametrize("sources, block", [(4, 6), (17, 2), (8, 1)])
def test_equals_the_definition(spark, monkeypatch, sources, block):
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", block)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 40)
    monkeypatch.setattr(divergence, "ROUNDS_AT_ONCE", 3)
    rows = table(sources, 120, sources)
    assert run(spark, rows) == brute(rows)


def test_ties_and_a_short_list(spark):
    rows = [("en", s, "b a c d e f") for s in "xyz"] * 2 + [("en", "w", "b a")]
    assert run(spark, rows, most_terms=2) == brute(rows, most=2)


def test_every_block_meets_every_other_once(spark):
    for blocks in (1, 2, 3, 4, 5, 8, 9, 64):
        df = spark.range(blocks).selectExpr("cast(id as int) block", f"{blocks} blocks")
        turns = blocks + blocks % 2 - 1
        met = []
        for t in range(turns + 2):
            pairs = [(r[0], r[1]) for r in df.select("block", divergence.mate(df["block"], df["blocks"], t)).collect() if r[1] is not None]
            assert all((b, a) in pairs for a, b in pairs)
            met += [p for p in pairs if p[0] < p[1]]
        assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_shares_and_vectors_are_exact():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9 * 10**13, 1000)
    whole = int(counts.max()) + 10**6
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts.tolist()]
    places = np.unique(r.integers(0, 10**6, 500))
    a, b = divergence.unpack(divergence.pack(places, counts[: len(places)]))
    assert (a == places).all() and (b == counts[: len(places)]).all()
    assert divergence.both_ways(np.array([10**9 + 1]), np.array([1])) == (10**18, 10**18 // (10**9 + 1))


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    rows = table(3, 60, 3)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert divergence.audit(empty_docs(spark).selectExpr("*", "hits source")).count() == 0
    docs = edge_docs(spark).selectExpr("*", "'s' source")
    assert {r["part"] for r in divergence.audit(docs).collect()} <= {"term"}
