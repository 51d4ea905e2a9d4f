"""Runs of a word sequence by the runs theorem.

Every run (a stretch with its smallest period that no neighbour extends) has a Lyndon root that
is the longest Lyndon word at its start under the order of the words or under the reverse order.
The longest Lyndon word at a place ends before the next suffix that is smaller, so it is a
next-smaller value of the inverse suffix array.  Each root is extended to the right by the
longest common prefix of two suffixes and to the left by that of two suffixes of the reversed
sequence, both minima over a range of the LCP array.

Texts of a batch are worked on together: the number of the text is the first key of every
suffix order, so suffixes of different texts never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of the texts that are worked on together; a longer text is worked on alone.
TOGETHER = 1_000_000
#: Rounds of pointer jumping before the places left over go down a tree of minima.
JUMPS = 24


class Suffixes:
    """Suffix order of the texts ``owner`` of ``values``; a suffix comes after its own prefixes.

    ``levels[k]`` ranks stretches of 2**k words (shorter at the end of a text), equal ones alike.
    """

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        n = len(values)
        width = int(values.max(initial=0)) + 1
        _, dense = np.unique(owner * width + values, return_inverse=True)
        last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
        self.end = last[owner] + 1  # owner numbers texts from 0 without gaps
        count = np.bincount(dense)
        rank = (np.cumsum(count) - count)[dense]  # how many are smaller
        self.levels = [rank]
        open_ = np.flatnonzero(count[dense] > 1)
        step = 1
        while len(open_):
            to = open_ + step
            inside = to < self.end[open_]
            second = np.where(inside, rank[np.minimum(to, n - 1)] + 1, 0)
            order = np.argsort(rank[open_] * (n + 1) + second)
            at, first, second = open_[order], rank[open_][order], second[order]
            new_first = np.r_[True, first[1:] != first[:-1]]
            new = new_first | np.r_[True, second[1:] != second[:-1]]
            place = np.arange(len(at))
            offset = place - np.maximum.accumulate(np.where(new_first, place, 0))  # place within the old rank
            start = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[at] = first + offset[start]
            self.levels.append(rank)
            size = np.bincount(np.cumsum(new) - 1)
            open_ = np.sort(at[np.repeat(size > 1, size)])
            step *= 2
        self.rank = rank
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)

    def common(self) -> np.ndarray:
        """Longest common prefix of each suffix with the one before it in the order."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(self.order), dtype=np.int64)
        open_ = np.ones(len(a), dtype=bool)
        equal, pairs = [], np.arange(len(a))
        for k in range(len(self.levels)):  # pairs that share 2**k words; equal ranks of stretches that fit are equal
            pairs = self._equal(k, pairs, a, b)
            equal.append(pairs)
        for k in range(len(self.levels) - 1, -1, -1):
            pairs = equal[k]
            at = self._equal(k, pairs[open_[pairs]], a, b)
            out[at + 1] += 1 << k
            a[at] += 1 << k
            b[at] += 1 << k
            open_[at] = (a[at] < self.end[self.order[at]]) & (b[at] < self.end[self.order[at + 1]])
        return out

    def _equal(self, k: int, pairs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Those of ``pairs`` whose next 2**k words are the same."""
        x, y, level = a[pairs], b[pairs], self.levels[k]
        same = level[x] == level[y]
        pairs, x, y = pairs[same], x[same], y[same]
        return pairs[(x + (1 << k) <= self.end[x]) & (y + (1 << k) <= self.end[y])]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high]`` for each query, by a sparse table kept one level at a time."""
    out = np.empty(len(low), dtype=values.dtype)
    size = high - low
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        asked = np.flatnonzero(level == k)
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k)])
    return out


def next_smaller(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place the next one of its text with a smaller rank, or the end of the text."""
    n = len(rank)
    out = np.arange(1, n + 1)
    bound = np.r_[rank, -1]
    active = np.flatnonzero((out < end) & (bound[out] > rank))
    for _ in range(JUMPS):
        if not len(active):
            return out
        out[active] = out[out[active]]
        to = out[active]
        active = active[(to < end[active]) & (bound[np.minimum(to, n)] > rank[active])]
    if len(active):  # up and down a tree of minima: a number of steps that does not depend on the ranks
        trees, size = [rank], 1
        while len(trees[-1]) > 1:
            t = trees[-1]
            t = np.r_[t, np.iinfo(np.int64).max] if len(t) % 2 else t
            trees.append(np.minimum(t[::2], t[1::2]))
        at, level = out[active].copy(), np.zeros(len(active), dtype=np.int64)
        want, stop = rank[active], end[active]
        up = np.ones(len(active), dtype=bool)
        done = np.zeros(len(active), dtype=bool)
        while not done.all():
            for k in range(len(trees)):  # at is a block of level k; all before it within reach are larger
                here = np.flatnonzero(~done & (level == k))
                if not len(here):
                    continue
                block = at[here]
                past = (block << k) >= stop[here]
                inside = np.where(block < len(trees[k]), trees[k][np.minimum(block, len(trees[k]) - 1)], -1)
                smaller = ~past & (inside < want[here])
                found = here[past | (smaller & (k == 0))]
                at[found] <<= k
                done[found] = True
                down = here[smaller & (k > 0)]
                at[down] *= 2
                level[down] = k - 1
                up[down] = False
                on = here[~past & ~smaller]
                at[on] += 1
                climb = on[(at[on] % 2 == 0) & up[on]]
                at[climb] //= 2
                level[climb] = k + 1
        out[active] = at
    return np.minimum(out, end)


def find(values: np.ndarray, owner: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least max(``least``, ``times`` periods) words.

    ``owner`` numbers the texts from 0 without gaps; starts are places in ``values``.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    n = len(values)
    none = np.array([], dtype=np.int64)
    if not n:
        return none, none, none
    forward = Suffixes(values, owner)
    backward_order = Suffixes(values.max() - values, owner)
    starts, ends = [], []
    for suffixes in (forward, backward_order):
        end = next_smaller(suffixes.rank, suffixes.end)
        # The first root of a run starts again at its end.
        i = np.flatnonzero(end < suffixes.end)
        i = i[values[i] == values[end[i]]]
        starts.append(i)
        ends.append(end[i])
    both = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(ends))
    i, j = both // (n + 1), both % (n + 1)
    if not len(i):
        return none, none, none
    period = j - i
    right = prefix_lengths(forward, forward.common(), i, j)
    keep = right >= (times - 2) * period
    i, j, period, right = i[keep], j[keep], period[keep], right[keep]
    if not len(i):
        return none, none, none
    left = left_lengths(values, owner, i, j)
    keep = left < period  # of the roots of a run the first one stands for it
    i, period, right, left = i[keep], period[keep], right[keep], left[keep]
    length = left + period + right
    keep = length >= np.maximum(least, times * period)
    start, length, period = (i - left)[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    if not len(start):
        return start, length, period
    first = np.r_[True, (np.diff(start) != 0) | (np.diff(period) != 0)]  # both orders may name a run of one word
    return start[first], length[first], period[first]


def prefix_lengths(suffixes: Suffixes, common_: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``i`` and ``j``."""
    a, b = suffixes.rank[i], suffixes.rank[j]
    return range_minima(common_, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def left_lengths(values: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common suffix of what lies before ``i`` and before ``j``, in the texts they lie in."""
    texts = np.unique(owner[i])
    inside = np.zeros(int(owner[-1]) + 1, dtype=bool)
    inside[texts] = True
    at = np.flatnonzero(inside[owner])[::-1]  # these texts alone, reversed
    new = np.cumsum(np.r_[False, owner[at][1:] != owner[at][:-1]])
    suffixes = Suffixes(values[at], new)
    place = np.full(len(values), -1)
    place[at] = np.arange(len(at))
    out = np.zeros(len(i), dtype=np.int64)
    asked = np.flatnonzero((i > 0) & (owner[np.maximum(i - 1, 0)] == owner[i]))
    if len(asked):
        out[asked] = prefix_lengths(suffixes, suffixes.common(), place[i[asked] - 1], place[j[asked] - 1])
    return out


# -- texts ----------------------------------------------------------------------------------------

Edit = Callable[[object, int], np.ndarray | None]


class Texts:
    """The words of some texts, after an edit that names for each place the word it takes."""

    def __init__(self, keys: list, texts: list[str | None], edit: Edit | None):
        self.words: list[list[bytes]] = []
        for key, t in zip(keys, texts, strict=True):
            words = t.encode("utf-8").split() if t else []  # bytes part at the six ASCII white spaces alone
            if edit is not None and words and (to := edit(key, len(words))) is not None:
                words = list(map(words.__getitem__, to.tolist()))
            self.words.append(words)
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        flat = np.empty(int(self.sizes.sum()), dtype=object)
        flat[:] = [w for words in self.words for w in words]
        self.values = pd.factorize(flat)[0].astype(np.int64)
        full = self.sizes > 0
        self.number = np.cumsum(full) - 1  # of texts with words
        self.owner = np.repeat(self.number, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def rows(self, times: int, least: int) -> Iterator[tuple]:
        """Per text: its runs (start, length, period) and its words outside repeated periods."""
        start, length, period = find(self.values, self.owner, times, least)
        cut = np.searchsorted(start, np.r_[self.first, len(self.values)])
        gone = np.zeros(len(self.values) + 1, dtype=np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + length, -1)
        gone = np.cumsum(gone)[:-1] > 0
        for k, words in enumerate(self.words):
            a, b, at = int(cut[k]), int(cut[k + 1]), int(self.first[k])
            if a == b:
                yield [], b" ".join(words)
            else:
                runs = list(zip((start[a:b] - at).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
                yield runs, b" ".join([w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g])


def groups(texts: list[str | None]) -> Iterator[slice]:
    """Slices of a batch with a bounded number of characters each, or of one text."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > TOGETHER:
            yield slice(begin, k)
            begin, held = k, 0
        held += size
    yield slice(begin, len(texts))


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def collapse(docs: DataFrame, edit: Edit | None = None, times: int = 4, least: int = 6, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the run of the greatest length to period (ties: the smallest
    start, then period) as start, length, period, exponent_milli, and the digests of all runs
    and of the words outside repeated periods; ``with_text`` adds ``runs`` and ``collapsed``.

    Words are separated by ASCII white space.  Null and empty texts have no words and no run:
    four nulls and digests of nothing.  Repeated rows give repeated results; columns besides
    doc_id and text are not read; an empty table gives no rows.  A text is worked on whole,
    memory grows with the longest.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for part in groups(texts):
            for runs, kept in Texts(keys[part], texts[part], edit).rows(times, least):
                best = best_run(runs)
                row = [len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
                listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs])
                row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if with_text:
                    row += [[{"start": s, "length": n, "period": p} for s, n, p in runs], kept.decode("utf-8")]
                out.append(row)
        columns = list(zip(*out, strict=True))
        arrays = [batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema, types = SCHEMA, [pa.int64()] * 5 + [pa.string()] * 2
    if with_text:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
        types = [*types, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, run, schema)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length to period; of equal ones that with the smallest start, then period."""
    best = None
    for run in runs:  # in order of start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best
