"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the leftmost S of each run starts an LMS
substring. Those are sorted by inducing, named, and sorted as suffixes by recursion on the string of names; from the sorted
LMS suffixes first the L, then the S suffixes are induced. Over a byte alphabet a bucket is induced at a time with array
operations: all that a bucket's entries induce goes to its places at once, and again for what lands in the same bucket.
Over the large alphabets of the recursion, with a few entries a bucket, all buckets are induced at once: each suffix hangs
on a chain of falling (L) or rising (S) symbols that ends in a sorted suffix, and chains are ranked by doubling.
"""

from __future__ import annotations

import numpy as np

BLOCKWISE = 1 << 10  # the largest alphabet that is induced a bucket at a time


def types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the last symbol of s is its unique least one."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce_blocks(s: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array (or order of LMS substrings) from LMS positions in the order of their buckets."""
    n, k = len(s), len(ends)
    heads = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)

    def put(block: np.ndarray, want_s: bool, ptr: np.ndarray) -> None:
        p = block[block > 0] - 1
        p = p[is_s[p] == want_s]
        if not len(p):
            return
        c = s[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        counts = np.bincount(c, minlength=k)
        turn = np.arange(len(p)) - np.repeat((np.cumsum(counts) - counts)[counts > 0], counts[counts > 0])
        if want_s:
            sa[ptr[c] - 1 - turn] = p
            ptr -= counts
        else:
            sa[ptr[c] + turn] = p
            ptr += counts

    chars = s[lms]
    first, last = np.searchsorted(chars, np.arange(k)), np.searchsorted(chars, np.arange(k), "right")
    used = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
    ptr = heads.copy()
    for c in used.tolist():
        at = heads[c]
        while at < ptr[c]:
            block, at = sa[at : ptr[c]].copy(), int(ptr[c])
            put(block, False, ptr)
        if last[c] > first[c]:
            put(lms[first[c] : last[c]], False, ptr)
    l_ends, ptr = ptr, ends.copy()
    for c in used[::-1].tolist():
        at = ends[c]
        while at > ptr[c]:
            block, at = sa[ptr[c] : at][::-1].copy(), int(ptr[c])
            put(block, True, ptr)
        put(sa[heads[c] : l_ends[c]][::-1].copy(), True, ptr)
    sa[0] = n - 1
    return sa


def _ranked(keys: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Items in order of their chains; keys: each one's own key, alone at a chain's end; follow: the next item, itself at the end.

    Chains are compared by doubling: after a round, ranks tell twice as many steps apart. A rank is the place where its ties
    begin, so that only ties are sorted again.
    """
    order = np.argsort(keys, kind="stable")
    sorted_, rank = keys[order], np.empty(len(keys), np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(keys))))
    sizes = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
    places = np.flatnonzero(sizes > 1)
    while len(places):
        tied = order[places]
        key = rank[tied] * len(keys) + rank[follow[tied]]
        turn = np.argsort(key, kind="stable")
        tied, key = tied[turn], key[turn]
        order[places] = tied
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(tied)))
        rank[tied] = np.repeat(places[first], counts)
        follow = follow[follow]
        places = places[np.repeat(counts, counts) > 1]
    return order


def _induce_ranks(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induce_blocks, for large alphabets: first the L suffixes by the chains that lead to sorted LMS ones, then the S likewise."""
    n = len(s)
    wanted = ~is_s
    ends, item = lms, np.full(n, -1, np.int64)
    for mark in (0, 1):  # an L suffix precedes an S suffix of the same symbol
        own = np.flatnonzero(wanted)
        at = np.concatenate([ends, own])
        item[at] = np.arange(len(at))
        # Of equal symbols, each end has a key of its own, in the given order; the suffixes to be induced share one before or after them.
        symbol = s[at] * (len(ends) + 2)
        keys = symbol + (np.where(np.arange(len(at)) < len(ends), 1 + np.arange(len(at)), (len(ends) + 1) * mark))
        follow = np.concatenate([np.arange(len(ends)), item[np.minimum(own + 1, n - 1)]])
        order = at[_ranked(keys, follow)]
        if mark == 0:
            ends = order[~is_s[order]]
            wanted = is_s
    return order


def _induce(s, is_s, ends, lms, blockwise: bool) -> np.ndarray:
    return _induce_blocks(s, is_s, ends, lms) if blockwise else _induce_ranks(s, is_s, lms)


def _names(s: np.ndarray, is_lms: np.ndarray, order: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A number for each sorted LMS substring, equal for equal ones."""
    stop = np.full(len(s), len(s) - 1)
    stop[positions[:-1]] = positions[1:]
    a, b = order[:-1], order[1:]
    size = stop[a] - a + 1
    same = (size == stop[b] - b + 1) & (a < len(s) - 1) & (b < len(s) - 1)
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        equal = s[a[open_] + step] == s[b[open_] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (size[open_] > step)]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Of a string of numbers under `alphabet` whose last is 0 and occurs nowhere else."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    positions = np.flatnonzero(is_lms)
    ends, blockwise = np.cumsum(np.bincount(s, minlength=alphabet)), alphabet <= BLOCKWISE
    start = positions[np.argsort(s[positions], kind="stable")]
    sa = _induce(s, is_s, ends, start, blockwise)
    order = sa[is_lms[sa]]
    names = _names(s, is_lms, order, positions)
    if names[-1] + 1 < len(order):
        short = np.empty(n, np.int64)
        short[order] = names
        order = positions[suffix_array(short[positions], int(names[-1]) + 1)]
    return _induce(s, is_s, ends, order, blockwise)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """By position: the common prefix with the suffix before it in sa, where symbols up to `stop` equal nothing.

    Only positions whose left neighbours differ are compared; at others the prefix is one less than at the position before.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, bool)
    at = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    reducible[at] = (s[at - 1] == s[before[at] - 1]) & (s[at - 1] > stop)
    start = np.flatnonzero(~reducible)
    length = np.zeros(n, np.int64)
    open_ = start[before[start] >= 0]
    step = 0
    while len(open_):
        a, b = open_ + step, before[open_] + step
        inside = (a < n) & (b < n)
        equal = np.zeros(len(open_), bool)
        equal[inside] = (s[a[inside]] == s[b[inside]]) & (s[a[inside]] > stop)
        open_ = open_[equal]
        step += 1
        length[open_] = step
    last = np.maximum.accumulate(np.where(~reducible, np.arange(n), 0))
    return np.maximum(length[last] - (np.arange(n) - last), 0)
