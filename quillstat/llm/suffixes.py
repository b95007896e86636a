"""Suffix arrays by induced sorting, in whole-array steps."""

from __future__ import annotations

import numpy as np

from quillstat.llm.words import mix

SMALL_ALPHABET = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last symbol must be the smallest and unique."""
    step = np.sign(t[1:].astype("int64") - t[:-1])
    place = np.where(step != 0, np.arange(len(step)), len(step))
    ahead = np.minimum.accumulate(place[::-1])[::-1]  # the next change of symbol decides a run of equal ones
    small = np.ones(len(t), bool)
    small[:-1] = np.where(ahead < len(step), step[np.minimum(ahead, len(step) - 1)] > 0, True)
    return small


def _induce(t: np.ndarray, small: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Suffix array from the order of the leftmost-smaller suffixes: larger suffixes from left to right, then smaller ones from right to left.

    A bucket is worked through in waves: the predecessors of what it holds so far are appended to their buckets together.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(sizes) <= 1 << 16:
        t = t.astype("uint16")  # sorted by radix
    sa = np.full(len(t), -1, "int64")
    symbols = t[leftmost]
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    count = np.bincount(symbols, minlength=len(sizes))
    sa[ends[sorted_symbols] - count[sorted_symbols] + np.arange(len(order)) - (np.cumsum(count) - count)[sorted_symbols]] = leftmost[order]

    def spread(items: np.ndarray, at: np.ndarray, want: bool, sign: int) -> None:
        before = items[items > 0] - 1
        before = before[small[before] == want]
        if len(before):
            s = t[before]
            o = np.argsort(s, kind="stable")
            s, before = s[o], before[o]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            lengths = np.diff(np.concatenate([first, [len(s)]]))
            rank = np.arange(len(s)) - np.repeat(first, lengths)
            sa[at[s] + sign * rank] = before
            at[s[first]] += sign * lengths

    head = starts.copy()
    used = np.flatnonzero(sizes)
    for c in used:
        low = starts[c]
        while low < head[c]:
            high = head[c]
            spread(sa[low:high], head, False, 1)
            low = high
        if count[c]:
            spread(sa[ends[c] - count[c] : ends[c]], head, False, 1)
    larger = head  # the end of each bucket's larger suffixes
    tail = ends - 1
    for c in used[::-1]:
        high = ends[c] - 1
        while high > tail[c]:
            low = tail[c]
            spread(sa[low + 1 : high + 1][::-1], tail, True, -1)
            high = low
        spread(sa[starts[c] : larger[c]][::-1], tail, True, -1)
    sa[0] = len(t) - 1
    return sa


def _by_doubling(t: np.ndarray) -> np.ndarray:
    rank, width = t.astype("int64"), 1
    while True:
        ahead = np.zeros(len(t), "int64")
        ahead[: len(t) - width] = rank[width:] + 1
        both = (rank.astype("uint64") << np.uint64(32)) | ahead.astype("uint64")
        order = np.argsort(both)
        fresh = np.concatenate([[0], both[order][1:] != both[order][:-1]]).cumsum()
        rank[order] = fresh
        if fresh[-1] == len(t) - 1:
            return order
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t`` (non-negative integers, the last one smallest and unique).

    Leftmost-smaller substrings are sorted by an induction from their unsorted places and named; if names repeat, the string of names is sorted
    by the same steps, or by rank doubling once its alphabet is too large for work by bucket; then all suffixes are induced from that order.
    """
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    small = classify(t)
    sizes = np.bincount(t)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, sizes, leftmost)
    is_leftmost = np.zeros(len(t), bool)
    is_leftmost[leftmost] = True
    ordered = sa[is_leftmost[sa]]
    following = np.full(len(t), len(t), "int64")
    following[leftmost[:-1]] = leftmost[1:] + 1
    weights = np.cumprod(np.full(len(t), 0x9E3779B97F4A7C15, "uint64"))
    back = np.cumprod(np.full(len(t), pow(0x9E3779B97F4A7C15, -1, 2**64), "uint64"))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(t.astype("uint64") + np.uint64(99)) * weights)])
    content = (sums[following[ordered]] - sums[ordered]) * back[ordered]
    length = following[ordered] - ordered
    fresh = np.concatenate([[0], (content[1:] != content[:-1]) | (length[1:] != length[:-1])]).cumsum()
    if fresh[-1] < len(ordered) - 1:
        names = np.zeros(len(t), "int64")
        names[ordered] = fresh
        reduced = names[leftmost]
        ordered = leftmost[suffix_array(reduced) if fresh[-1] < SMALL_ALPHABET else _by_doubling(reduced)]
    return _induce(t, small, sizes, ordered)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one little-endian number (zeros past the end)."""
    return np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, "uint8")]), 0, (1,))


def common_prefixes(data: np.ndarray, sa: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes, up to ``limit``: for each of ``places``, in text order, the bytes its suffix shares with the one before it in the array."""
    before = np.full(len(sa), -1, "int64")
    before[sa[1:]] = sa[:-1]
    w = words_at(np.concatenate([data, np.zeros(limit + 8, "uint8")]))
    out = np.full(len(places), limit, "int64")
    out[before[places] < 0] = 0
    active = np.flatnonzero(before[places] >= 0)
    for off in range(0, limit, 8):
        x = w[places[active] + off] ^ w[before[places[active]] + off]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[active[differ]] = np.minimum(limit, off + np.bitwise_count(low - np.uint64(1)).astype("int64") // 8)
        active = active[~differ]
    return out
