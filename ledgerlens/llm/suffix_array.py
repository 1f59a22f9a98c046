"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classed by comparison with their right neighbour; the leftmost-smaller
substrings are sorted by one induction, named, and sorted by recursion if names
repeat; a second induction orders all suffixes. An induction walks the array once and
appends each predecessor to its bucket. Here it takes runs of entries at once: as many
as come before the first slot that the run itself fills, so the order is that of
the walk and every entry is still touched once.
"""

from __future__ import annotations

import numpy as np

RUN = 1024
MOST_RUN = 1 << 17
STEP = 16
#: Rows compared at once.
ROWS = 1 << 15


def _smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one, a sentinel, is."""
    n = len(s)
    differ = np.full(n, n - 1, np.int32)
    at = np.flatnonzero(s[:-1] != s[1:])
    differ[at] = at
    differ = np.minimum.accumulate(differ[::-1])[::-1]
    up = np.empty(n, bool)
    up[:-1] = s[:-1] < s[1:]
    up[-1] = True
    return up[differ]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key its rank among equal keys so far; then order, first places and counts of groups."""
    order = keys.argsort(kind="stable")
    ordered = keys[order]
    first = np.empty(len(keys), bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    start = first.nonzero()[0]
    count = np.empty_like(start)
    count[:-1] = start[1:] - start[:-1]
    count[-1] = len(keys) - start[-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - start.repeat(count)
    return rank, order, start, count


def _walk(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, free: np.ndarray) -> None:
    """One induction: predecessors of the ``wanted`` kind go to the next free slots.

    ``sa`` is read from its start; for the second induction it is a reversed view, as
    are the slots.
    """
    n, p, run = len(sa), 0, RUN
    while p < n:
        q = min(p + run, n)
        x = sa[p:q]
        at = (x > 0).nonzero()[0]
        j = x[at] - 1
        mine = wanted[j]
        at, j = at[mine], j[mine]
        if not len(at):
            p, run = q, min(2 * run, MOST_RUN)
            continue
        c = s[j]
        rank, order, start, count = _grouped(c)
        slot = free[c] + rank
        reach = np.minimum.accumulate(slot)
        # An entry is final if nothing before it in this run lands before it.
        stop = (reach[:-1] <= at[1:] + p).nonzero()[0]
        if len(stop):
            k, end = int(stop[0]) + 1, int(reach[stop[0]])
        else:
            k, end = len(at), min(q, int(reach[-1]))
        if k == len(at):
            sa[slot] = j
            free[c[order[start]]] += count
        else:
            sa[slot[:k]] = j[:k]
            last = np.maximum.reduceat(np.where(order < k, rank[order], -1), start)
            free[c[order[start]]] += last + 1
        run = min(2 * run, MOST_RUN) if end == q else max(RUN // 4, 2 * (end - p))
        p = end


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given leftmost-smaller ones in (some) order of their first letters."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(sizes)
    c = s[lms]
    rank, order, start, count = _grouped(c)
    total = np.zeros(len(sizes), np.int64)
    total[c[order[start]]] = count
    sa[ends[c] - total[c] + rank] = lms
    _walk(sa, s, ~up, ends - sizes)
    sa[0] = n - 1
    _walk(sa[::-1], s, up, n - ends)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings, equal ones alike, in text order."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    size = length[a]
    equal = size == length[b]
    open_ = equal.nonzero()[0]
    for k in range(int(size.max(initial=0))):  # letter by letter, for those still equal
        if not len(open_):
            break
        same = s[a[open_] + k] == s[b[open_] + k]
        equal[open_[~same]] = False
        open_ = open_[same]
        open_ = open_[size[open_] > k + 1]
    name = np.zeros(n, np.int32)
    name[ordered[1:]] = np.cumsum(~equal)
    return name[lms]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``: letters from 1, and a last letter 0 found nowhere else."""
    n = len(s)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    most = int(s.max())
    s = s.astype(np.uint16 if most < 1 << 16 else np.int32)  # short letters sort faster
    up = _smaller_than_next(s)
    lms = ((up[1:] & ~up[:-1]).nonzero()[0] + 1).astype(np.int32)
    sizes = np.bincount(s)
    first = _induce(s, up, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names = _names(s, lms, ordered)
    if int(names.max()) + 1 < len(lms):
        ordered = lms[suffix_array(names)]
    return _induce(s, up, ordered, sizes)


def common_prefixes(s: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position the suffix before it in order, and the letters both share.

    ``left`` is the number of letters a position has before its separator; nothing
    beyond is counted. A position whose left neighbour is preceded by the same
    letter shares one letter less than the neighbour did; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int32)
    i = np.arange(n, dtype=np.int32)
    reducible = np.zeros(n, bool)
    at = ((before[1:] > 0) & (left[1:] > 0)).nonzero()[0] + 1
    at = at[(left[at - 1] > 0) & (left[before[at] - 1] > 0) & (s[at - 1] == s[before[at] - 1])]
    reducible[at] = True
    compared = (~reducible & (before >= 0) & (left > 0)).nonzero()[0]
    for k in range(0, len(compared), ROWS):
        open_ = compared[k:k + ROWS]
        most, done = np.minimum(left[open_], left[before[open_]]), 0
        open_, most = open_[most > 0], most[most > 0]
        while len(open_):
            offset = done + np.arange(STEP)
            same = (s[np.minimum(open_[:, None] + offset, n - 1)]
                    == s[np.minimum(before[open_][:, None] + offset, n - 1)])
            run = np.where(same.all(1), STEP, same.argmin(1))
            shared[open_] = np.minimum(done + run, most)
            done += STEP
            more = (run == STEP) & (most > done)
            open_, most = open_[more], most[more]
    start = np.maximum.accumulate(np.where(reducible, 0, i))
    shared = np.where(reducible, shared[start] - (i - start), shared)
    return before, np.maximum(shared, 0)


def repeated_windows(texts: list[bytes], window: int) -> list[np.ndarray]:
    """Of each text the positions where a window starts that starts elsewhere too."""
    if not texts:
        return []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 1
    raw[-1] = 0
    left = np.zeros(len(raw), np.int32)
    left[:-1] = np.repeat(ends, sizes + 1) - np.arange(len(raw) - 1)
    before, shared = common_prefixes(raw, suffix_array(raw), left)
    found = np.flatnonzero(shared >= window)
    hit = np.zeros(len(raw), bool)
    hit[found] = True
    hit[before[found]] = True
    starts = ends - sizes
    return [np.flatnonzero(hit[a:a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
