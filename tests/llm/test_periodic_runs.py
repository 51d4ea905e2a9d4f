import hashlib
import random
import zlib

import numpy as np
import pytest

from quirework.llm import common, periodic_runs, queries

from .cases import edge_docs, edge_rows, empty_docs


def brute(words: list, times: int, least: int) -> list[tuple[int, int, int]]:
    """Every maximal stretch of each period that has no smaller period."""
    _, w = np.unique(np.array([hash(x) for x in words], dtype=np.int64), return_inverse=True)
    n, out = len(w), []
    for q in range(1, n // times + 1):
        same = np.r_[False, w[: n - q] == w[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + q
            if length >= max(least, times * q) and not any((w[a : a + length - d] == w[a + d : a + length]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts: list[list], times: int, least: int) -> list[list[tuple[int, int, int]]]:
    sizes = [len(t) for t in texts]
    values = np.array([x for t in texts for x in t], dtype=np.int64)
    full = [s for s in sizes if s]
    owner = np.repeat(np.arange(len(full)), full)
    got = list(zip(*(x.tolist() for x in periodic_runs.find(values, owner, times, least)), strict=True))
    out, at = [], 0
    for s in sizes:
        out.append([(a - at, n, q) for a, n, q in got if at <= a < at + s])
        at += s
    assert sum(map(len, out)) == len(got)
    return out


def sequences(seed: int, n: int) -> list[list[int]]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind, size = r.random(), r.randint(0, 60)
        if kind < 0.5:
            out.append([r.randint(0, r.choice([1, 2, 4])) for _ in range(size)])
        elif kind < 0.8:
            root = [r.randint(0, 2) for _ in range(r.randint(1, 9))]
            out.append([r.randint(0, 2) for _ in range(r.randint(0, 5))] + (root * 60)[:size] + [r.randint(0, 2) for _ in range(r.randint(0, 5))])
        else:
            a, b = [0], [0, 1]
            while len(b) < 50:
                a, b = b, b + a
            out.append(b[:size])
    return out


@pytest.mark.parametrize("times, least", [(2, 2), (3, 5), (4, 6)])
def test_all_runs_equal_brute_force(times, least):
    texts = sequences(times, 400)
    assert found(texts, times, least) == [brute(t, times, least) for t in texts]


def test_next_smaller_equals_a_stack(monkeypatch):
    monkeypatch.setattr(periodic_runs, "JUMPS", 1)
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 1000):
        for rank in (r.permutation(n), np.arange(n), np.arange(n)[::-1].copy(), np.r_[0, np.arange(n)[:0:-1]] if n > 1 else np.array([0])):
            cut = np.unique(np.r_[r.integers(1, n + 1, 3), n])
            end = cut[np.searchsorted(cut, np.arange(n), side="right")]
            expected = [next((j for j in range(i + 1, end[i]) if rank[j] < rank[i]), end[i]) for i in range(n)]
            assert periodic_runs.next_smaller(rank, end).tolist() == expected


def test_suffix_order_and_common_prefixes():
    for texts in (sequences(9, 30), [[1] * 40, [1] * 40, [2]]):
        texts = [t for t in texts if t]
        values = np.array([x for t in texts for x in t])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        s = periodic_runs.Suffixes(values, owner)
        tails = [(k, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]
        order = sorted(range(len(tails)), key=tails.__getitem__)
        assert s.order.tolist() == order
        for r, n in enumerate(s.common().tolist()):
            (ka, a), (kb, b) = tails[order[r]], tails[order[r - 1]]
            assert n == (0 if r == 0 or ka != kb else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def expected_row(doc_id, text, edited=True):
    words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    n = len(words)
    if edited and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 4, 6)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_whole_table(spark, small):
    docs = common.read_table(spark, small, "documents").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, small).collect()))
    assert got == sorted(expected_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) > len(docs) // 20


def test_edges(spark):
    rows = [*edge_rows(), (30, "x " * 500), (31, "a b " * 300 + "c"), (32, "a b c"), (None, "z z z z z z")]
    docs = spark.createDataFrame([(t, 1, d) for d, t in rows], "text string, n_runs int, doc_id long")
    got = periodic_runs.collapse(docs, queries.periodic_tail).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_row(d, t)) for d, t in rows)
    assert periodic_runs.collapse(empty_docs(spark)).count() == 0
    assert periodic_runs.collapse(edge_docs(spark)).count() == len(edge_rows())


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go on go on go on go on\nnow"), (2, None)], "doc_id long, text string")
    a, b = sorted(periodic_runs.collapse(docs, with_text=True).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r) for r in a["runs"]] == [(0, 8, 2)] and a["collapsed"] == "go on now" and a["exponent_milli"] == 4000
    assert b["runs"] == [] and b["collapsed"] == "" and b["start"] is None
