"""Suffix array of an integer sequence by the difference-cover algorithm modulo 3, in numpy.

The triples at positions that are not multiples of 3 are sorted and named; if names repeat,
the sequence of names is sorted by recursion.  The remaining suffixes are sorted by their
first symbol and the rank of the next suffix, and merged in.
"""

from __future__ import annotations

import numpy as np


def _dense(a: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(a, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``s`` (integers >= 0) in ascending order; a shorter suffix comes first."""
    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    if n < 2:
        return np.arange(n)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    size = int(s.max()) + 2  # symbols shift by one: 0 stands behind the end
    if size**3 >= 2**62:
        s, size = _dense(s)
        size += 1
    t = np.concatenate([s + 1, np.zeros(3, dtype=np.int64)])
    # With n = 1 mod 3 the empty suffix at n joins the sample, so that the parts of the
    # name sequence end with a smallest name of their own.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if size**3 < 2**62:
        key = (t[sample] * size + t[sample + 1]) * size + t[sample + 2]
    else:
        pair, pairs = _dense(t[sample] * size + t[sample + 1])
        key = pair * size + t[sample + 2]
    order = np.argsort(key)
    ordered = key[order]
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    if len(sample) > 1 and names[order[-1]] + 1 < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(len(sample))
    rank = np.zeros(n + 3, dtype=np.int64)  # of sampled suffixes, from 1; 0 behind the end
    rank[sample] = names + 1
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    zeros = np.arange(0, n, 3)
    most = len(sample) + 2
    key0 = t[zeros] * most + rank[zeros + 1]
    zeros = zeros[np.argsort(key0)]
    # Sampled suffixes that are smaller than each of the others: by one symbol and a rank
    # against those at 1 mod 3, by two symbols and a rank against those at 2 mod 3.
    one = sorted_sample[sorted_sample % 3 == 1]
    two = sorted_sample[sorted_sample % 3 == 2]
    below = np.searchsorted(t[one] * most + rank[one + 1], t[zeros] * most + rank[zeros + 1])
    if size * size * most < 2**62:
        pair_of = lambda i: t[i] * size + t[i + 1]
        below += np.searchsorted(pair_of(two) * most + rank[two + 2], pair_of(zeros) * most + rank[zeros + 2])
    else:
        pair, _ = _dense(np.concatenate([t[two] * size + t[two + 1], t[zeros] * size + t[zeros + 1]]))
        below += np.searchsorted(pair[: len(two)] * most + rank[two + 2], pair[len(two) :] * most + rank[zeros + 2])
    out = np.empty(n, dtype=np.int64)
    place = below + np.arange(len(zeros))
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = sorted_sample
    return out
