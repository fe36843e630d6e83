"""Suffix arrays by induced sorting, and permuted common prefixes, for the strings of one shard."""

from __future__ import annotations

import numpy as np

#: Up to this alphabet buckets are large enough to be handled whole, one after another.
WIDE = 1024


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the last position counts as smaller)."""
    n = len(t)
    rise = np.ones(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    settled = np.where(rise != 0, np.arange(n), n - 1)
    return rise[np.minimum.accumulate(settled[::-1])[::-1]] > 0


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of a smaller type whose predecessor is of the larger type."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce_buckets(t: np.ndarray, smaller: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Both scans, one bucket at a time; what a block of a bucket induces is dealt out stably at once."""
    n, sigma = len(t), len(first) - 1
    sa = np.full(n, -1, np.int64)
    head, tail = first[:-1].copy(), first[1:].copy()
    chars = t[order]
    counts = np.bincount(chars, minlength=sigma)
    seed = np.concatenate(([0], np.cumsum(counts)))

    def deal(pred: np.ndarray, forward: bool) -> None:
        to = t[pred]
        rank = np.argsort(to, kind="stable")
        got = np.bincount(to, minlength=sigma)
        to, pred = to[rank], pred[rank]
        inner = np.arange(len(to)) - np.concatenate(([0], np.cumsum(got)))[to]
        if forward:
            sa[head[to] + inner] = pred
            head.__iadd__(got)
        else:
            sa[tail[to] - 1 - inner] = pred
            tail.__isub__(got)

    present = np.flatnonzero(np.diff(first))
    for c in present:
        at = first[c]
        while at < head[c]:
            block, at = sa[at : head[c]], head[c]
            pred = block[block > 0] - 1
            pred = pred[~smaller[pred]]
            if len(pred):
                deal(pred, True)
        block = order[seed[c] : seed[c + 1]]
        pred = block[block > 0] - 1
        pred = pred[~smaller[pred]]
        if len(pred):
            deal(pred, True)
    for c in present[::-1]:
        at = first[c + 1]
        while at > tail[c]:
            block, at = sa[tail[c] : at][::-1], tail[c]
            pred = block[block > 0] - 1
            pred = pred[smaller[pred]]
            if len(pred):
                deal(pred, False)
        block = sa[first[c] : head[c]][::-1]
        pred = block[block > 0] - 1
        pred = pred[smaller[pred]]
        if len(pred):
            deal(pred, False)
    sa[0] = n - 1
    return sa


def _ranked_by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string over many names: ranks by 1, 2, 4, .. names until all differ."""
    n = len(t)
    rank, width = t.copy(), 1
    while True:
        key = rank * np.int64(int(rank.max()) + 2)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, width = new, 2 * width


def _same_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of the given sizes at a and b are equal, pair by pair."""
    same = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[size[live] > k]
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        live, k = live[~differ], k + 1
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``t`` in their order.

    ``t`` holds non-negative integers and ends with a 0 that occurs nowhere else. Suffixes are classified, the
    leftmost-smaller substrings sorted by inducing and, where their names repeat, by the suffix array of the string
    of names; the order of those suffixes induces that of all. The recursion ends with strings of more than
    :data:`WIDE` names, which are a fraction as long and are ranked by doubling.
    """
    t = np.asarray(t)
    n, sigma = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    if sigma > WIDE:
        return _ranked_by_doubling(t.astype(np.int64))
    t = t.astype(np.uint16)  # numpy sorts small integers in linear time
    smaller = suffix_types(t)
    first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=sigma))))
    left = leftmost_smaller(smaller)
    begin = _induce_buckets(t, smaller, first, left[np.argsort(t[left], kind="stable")])
    place = np.full(n, -1, np.int64)
    place[left] = np.arange(len(left))
    ranked = begin[place[begin] >= 0]
    stop = np.append(left[1:], n - 1)
    size = (stop - left + 1)[place[ranked]]
    fresh = np.ones(len(ranked), bool)
    alike = np.flatnonzero(size[1:] == size[:-1])
    fresh[alike + 1] = ~_same_substrings(t, ranked[alike], ranked[alike + 1], size[alike])
    names = np.empty(len(left), np.int64)
    names[place[ranked]] = np.cumsum(fresh) - 1
    order = left[suffix_array(names)] if not fresh.all() else ranked
    return _induce_buckets(t, smaller, first, order)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix of its suffix and the one before it in the array.

    In text order such lengths fall by one at most; where the characters before both suffixes agree, the length is
    exactly one less than its predecessor's, so only the other positions are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    open_ = before >= 0
    bound = open_ & (at > 0) & (before > 0)
    follows = np.zeros(n, bool)
    follows[bound] = t[at[bound] - 1] == t[before[bound] - 1]
    length = np.zeros(n, np.int64)
    live, k = np.flatnonzero(open_ & ~follows), 0
    while len(live):
        live = live[(live + k < n) & (before[live] + k < n)]
        live = live[t[live + k] == t[before[live] + k]]
        k += 1
        length[live] = k
    reach = np.where(follows | ~open_, -1, length + at)
    return np.where(open_, np.maximum(np.maximum.accumulate(reach) - at, 0), 0)
