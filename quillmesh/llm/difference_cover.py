"""Suffix order by the difference-cover algorithm (period 3), in numpy.

Suffixes at positions 1 and 2 modulo 3 are sorted by their first three symbols and
named; where names repeat, the string of names is ordered in turn, by the same
algorithm. The remaining suffixes are sorted by one symbol and the rank of what
follows, and merged in.
"""

from __future__ import annotations

import numpy as np


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different triples there are, and each one's rank from 1."""
    if max(int(x.max(initial=0)) for x in (a, b, c)) < 1 << 20:
        key = a << 40 | b << 20 | c
    else:
        pairs = np.unique(a << 31 | b, return_inverse=True)[1]
        key = pairs << 31 | c
    different, rank = np.unique(key, return_inverse=True)
    return len(different), rank + 1


def suffix_order(s: np.ndarray, levels: int = 64) -> np.ndarray:
    """Positions of `s` (int64, symbols from 1) in the order of their suffixes.

    `levels`: how many times names may be named again. After k levels a name stands for
    3 ** (k + 1) symbols; suffixes that agree on so many may then come in any order
    among themselves.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one past the end where the last is 0 modulo 3
    twos = np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    count, name = _names(t[sampled], t[sampled + 1], t[sampled + 2])
    if count < len(sampled) and levels:
        order = suffix_order(name, levels - 1)
    else:
        order = np.argsort(name, kind="stable")
    place = np.empty(len(sampled), np.int64)
    place[order] = np.arange(1, len(sampled) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = place
    sorted12 = sampled[order]
    rest = np.arange(0, n, 3)
    one = t[rest] << 31 | rank[rest + 1]
    by = np.argsort(one, kind="stable")
    rest, one = rest[by], one[by]
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(t[first] << 31 | rank[first + 1], one)
    where = np.concatenate([rest, second])
    if int(t.max()) < 1 << 16:
        two = t[where] << 47 | t[where + 1] << 31 | rank[where + 2]
    else:
        two = np.unique(t[where] << 31 | t[where + 1], return_inverse=True)[1] << 31 | rank[where + 2]
    before = before + np.searchsorted(two[len(rest) :], two[: len(rest)])
    if n % 3 == 1:
        sorted12 = sorted12[sorted12 < n]
        before = np.maximum(before - 1, 0)  # the one past the end is the smallest of all
    at = np.arange(len(rest)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sorted12
    return out
