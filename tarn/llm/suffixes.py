"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` is used on shards of some hundred KB inside Spark tasks.  At the first level, whose
alphabet is small, a bucket is induced at once with NumPy, dealt out by a radix sort of 16-bit symbols;
deeper levels are at most a half, then a quarter, of the text and have large alphabets with tiny
buckets, so they go suffix by suffix.  Both are linear in the text.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced by whole buckets; symbols fit 16 bits, which NumPy's stable sort takes by radix.
SMALL = 512
#: Positions of the text that one chain of common prefixes goes through.
CHAIN = 64


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for each suffix that is smaller than the one after it (S); the last one counts as S."""
    n = len(text)
    rises = np.zeros(n, dtype=bool)
    rises[-1] = True
    differ = np.ones(n, dtype=bool)
    differ[:-1] = text[:-1] != text[1:]
    rises[:-1] = text[:-1] < text[1:]
    # a run of equal symbols has the type of its last
    at = np.where(differ, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Starts of S suffixes that follow an L suffix, in text order."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _spread(taken: np.ndarray, keys: np.ndarray, edge: np.ndarray, step: int, sa: np.ndarray) -> None:
    """Puts ``taken`` into its buckets in order, from each bucket's edge on."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys, taken = keys[order], taken[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    nth = np.arange(len(keys)) - np.repeat(first, counts)
    sa[edge[keys] + step * nth] = taken
    edge[keys[first]] += step * counts


def _induce_buckets(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes ``seeds``, in order, induce."""
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(len(text), -1, dtype=np.int64)
    tail = end - 1
    _spread(seeds[::-1], text[seeds[::-1]], tail, -1, sa)
    head, seeded = start.copy(), tail + 1
    for c in np.flatnonzero(count):
        done = start[c]
        while True:
            block = sa[done : head[c]]
            if not len(block):
                break
            done = head[c]
            before = block[block > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(before, text[before], head, 1, sa)
        block = sa[seeded[c] : end[c]]
        before = block[block > 0] - 1
        before = before[~small[before]]
        if len(before):
            _spread(before, text[before], head, 1, sa)
    tail = end - 1
    for c in np.flatnonzero(count)[::-1]:
        done = end[c]
        while tail[c] + 1 < done:
            block = sa[tail[c] + 1 : done][::-1].copy()
            done = tail[c] + 1
            before = block[block > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(before, text[before], tail, -1, sa)
        block = sa[start[c] : head[c]][::-1]
        before = block[block > 0] - 1
        before = before[small[before]]
        if len(before):
            _spread(before, text[before], tail, -1, sa)
    sa[0] = len(text) - 1
    return sa


def _induce_each(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """As ``_induce_buckets``, suffix by suffix."""
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    n, symbols, is_small = len(text), text.tolist(), small.tolist()
    sa = [-1] * n
    tail = (end - 1).tolist()
    for i in seeds[::-1].tolist():
        c = symbols[i]
        sa[tail[c]] = i
        tail[c] -= 1
    head = (end - count).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (end - 1).tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = symbols[j]
            sa[tail[c]] = j
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """A name for each leftmost-smaller substring in text order; equal ones have one name."""
    n = len(text)
    stop = np.empty(n, dtype=np.int64)
    stop[starts[:-1]] = starts[1:]
    stop[starts[-1]] = n - 1
    a, b = in_order[:-1], in_order[1:]
    same = stop[a] - a == stop[b] - b
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = (text[x] == text[y]) & (small[x] == small[y])
        same[live[~equal]] = False
        live = live[equal & (x < stop[a[live]])]
        k += 1
    named = np.empty(n, dtype=np.int64)
    named[in_order] = np.concatenate([[0], np.cumsum(~same)])
    return named[starts]


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order.  ``text`` ends with its only 0, other symbols are
    positive and less than ``size``."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    size = int(text.max()) + 1 if size is None else size
    induce = _induce_buckets if size <= SMALL else _induce_each
    small = smaller_than_next(text)
    starts = leftmost_smaller(small)
    flags = np.zeros(n, dtype=bool)
    flags[starts] = True
    by_substring = induce(text, small, starts, size)
    in_order = by_substring[flags[by_substring]]
    names = _names(text, small, starts, in_order)
    most = int(names.max()) + 1
    if most < len(names):
        in_order = starts[suffix_array(names, most)]
    return induce(text, small, in_order, size)


def common_prefixes(raw: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each entry of ``sa`` but the first, how many bytes of ``raw`` it shares with the one before, at most ``cap``.

    The permuted array: it is filled in text order, where an entry shares at least one byte less than
    the one a place before it, so each place goes on from what the last one found.  The text is cut into
    chains of CHAIN places, and all chains take a step at a time together; a chain's bytes are compared
    CHAIN + ``cap`` times at most.  ``cap`` bytes follow each entry in ``raw``.
    """
    if len(sa) < 2:
        return np.zeros(0, dtype=np.int64)
    n = int(sa.max()) + 1
    before = np.full(-(-n // CHAIN) * CHAIN, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    permuted = np.zeros(len(before), dtype=np.int64)
    chains, steps = np.arange(0, len(before), CHAIN), before.reshape(-1, CHAIN)
    shared = np.zeros(len(chains), dtype=np.int64)
    last = np.full(len(chains), -1, dtype=np.int64)
    for step in range(CHAIN):
        other = steps[:, step]
        # what a place carries on holds if the place before it had an entry before it as well
        shared = np.where((other >= 0) & (last >= 0), np.maximum(shared - 1, 0), 0)
        live = np.flatnonzero((other >= 0) & (shared < cap))
        here, there = chains[live] + step, other[live]
        while len(live):
            equal = raw[here + shared[live]] == raw[there + shared[live]]
            live, here, there = live[equal], here[equal], there[equal]
            shared[live] += 1
            more = shared[live] < cap
            live, here, there = live[more], here[more], there[more]
        permuted[chains + step] = shared
        last = other
    return permuted[sa[1:]]
