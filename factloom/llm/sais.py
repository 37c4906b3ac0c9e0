"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; the substrings between leftmost smaller ones are
sorted by one induction, named, and recursively sorted where names repeat; a second induction then sorts all suffixes in time
linear in their number. A whole bucket is induced at once, wave by wave; where an alphabet is large, as in the recursion,
entries are induced one by one.
"""

from __future__ import annotations

import numpy as np


def smaller(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the suffix to their right; the last one is a unique least sentinel and counts as such."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        step = np.sign(s[1:].astype(np.int64) - s[:-1])
        at = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n - 2)[::-1])[::-1]
        out[:-1] = step[at] > 0
    return out


def _waves(s: np.ndarray, small: np.ndarray, seeds: list[np.ndarray], order: range, want: bool) -> list[np.ndarray]:
    """One pass of induction over the buckets in order. seeds: what stands beyond the induced part of each bucket, in scan
    order. Returns the induced part of each bucket in scan order."""
    waiting: list[list[np.ndarray]] = [[] for _ in seeds]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seeds)

    def deal(at: np.ndarray) -> None:
        kind = s[at]
        rank = np.argsort(kind, kind="stable")
        kind, at = kind[rank], at[rank]
        cut = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cut, cut[1:]):  # noqa: B905
            waiting[kind[a]].append(at[a:b])

    for c in order:
        got = []
        wave = np.concatenate(waiting[c]) if waiting[c] else out[c]
        waiting[c] = []
        while len(wave):
            got.append(wave)
            left = wave[wave > 0] - 1
            left = left[small[left] == want]
            own = s[left] == c
            if not own.all():
                deal(left[~own])
            wave = left[own]
        if got:
            out[c] = np.concatenate(got)
        left = seeds[c]
        if len(left):
            left = left[left > 0] - 1
            left = left[small[left] == want]
            if len(left):
                deal(left)
    return out


def _induce_buckets(s: np.ndarray, small: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    kind = s[marks]
    rank = np.argsort(kind, kind="stable")
    seeds = np.split(marks[rank], np.cumsum(np.bincount(kind, minlength=k))[:-1])
    larger = _waves(s, small, seeds, range(k), False)
    back = _waves(s, small, [x[::-1] for x in larger], range(k - 1, -1, -1), True)
    back[0] = np.array([len(s) - 1])  # the sentinel
    return np.concatenate([x for c in range(k) for x in (larger[c], back[c][::-1])])


def _induce_each(s: np.ndarray, small: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    size = np.bincount(s, minlength=k)
    end = np.cumsum(size)
    start = (end - size).tolist()
    tail = end.tolist()
    text, is_small = s.tolist(), small.tolist()
    sa = [-1] * len(text)
    for i in reversed(marks.tolist()):
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in range(len(text)):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[start[c]] = j
            start[c] += 1
    tail = end.tolist()
    for i in range(len(text) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = len(text) - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, k: int | None = None) -> np.ndarray:
    """s: non-negative numbers, the last one 0 and the only 0. All suffixes in order."""
    n = len(s)
    k = int(s.max()) + 1 if k is None else k
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = smaller(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_buckets if n > 64 * k else _induce_each
    if len(marks) > 1:
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        order = induce(s, small, marks, k)
        order = order[is_mark[order]]
        follow = np.full(n, n - 1)
        follow[marks[:-1]] = marks[1:]
        length = follow[order] - order + 1
        a, b = order[:-1], order[1:]
        same = length[1:] == length[:-1]
        which = np.flatnonzero(same)
        size = length[1:][which]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = s[np.repeat(a[which], size) + inside] != s[np.repeat(b[which], size) + inside]
        if len(which):
            same[which] = ~np.logical_or.reduceat(differs, np.cumsum(size) - size)
        name = np.zeros(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        reduced = name[marks]
        if reduced.max() + 1 < len(marks):
            marks = marks[suffix_array(reduced, int(reduced.max()) + 1)]
        else:
            marks = order
    return induce(s, small, marks, k)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix that its suffix shares with its predecessor in sa (0 for the first).

    Where the characters before both suffixes agree, the value is one less than that of the position before; only the others
    are compared, four characters at a time."""
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    plain = (at > 0) & (before > 0)
    plain[plain] = s[at[plain] - 1] == s[before[plain] - 1]
    plain[1:] &= before[:-1] >= 0
    first = np.flatnonzero(~plain)
    padded = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.uint64)
    word = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    value = np.zeros(n, np.int64)
    x, y = first[before[first] >= 0], before[first[before[first] >= 0]]
    own = x
    while len(x):
        differ = word[x] ^ word[y]
        equal = differ == 0
        low = differ[~equal] & (~differ[~equal] + np.uint64(1))
        value[own[~equal]] += np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, "right")
        own, x, y = own[equal], x[equal] + 4, y[equal] + 4
        value[own] += 4
        ended = np.maximum(x, y) >= n
        own, x, y = own[~ended], x[~ended], y[~ended]
    source = np.maximum.accumulate(np.where(plain, 0, at))
    return value[source] - (at - source)
