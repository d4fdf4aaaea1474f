"""Suffix arrays over whole numbers in numpy: prefix doubling, longest common prefixes, binary search."""

from __future__ import annotations

import numpy as np

PAD = 8


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``codes`` (0 and up) in order.

    The first key packs as many codes as fit in 62 bits; each further round doubles the length compared, and
    sorts only those suffixes that still share their place with another.
    """
    n = codes.size
    if n == 0:
        return np.empty(0, np.int64)
    bits = max(1, int(codes.max() + 1).bit_length())
    width = max(1, 62 // bits)
    # a code is stored one up, so that the end of the text sorts first
    padded = np.zeros(n + width, np.int64)
    padded[:n] = codes + 1
    key = padded[:n].copy()
    for j in range(1, width):
        key <<= bits
        key |= padded[j : n + j]
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.zeros(n + 1, np.int64)
    place = np.zeros(n, np.int64)
    place[heads] = heads
    np.maximum.accumulate(place, out=place)
    rank[order] = place + 1
    shared = np.diff(np.concatenate((heads, [n]))) > 1
    slots = np.flatnonzero(np.repeat(shared, np.diff(np.concatenate((heads, [n])))))
    while slots.size:
        at = order[slots]
        key = (rank[at] << 31) | rank[np.minimum(at + width, n)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((first, [slots.size])))
        rank[at] = np.repeat(slots[first] + 1, sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


def common(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of text[at:] and query[start:], up to ``limit``; both padded by PAD codes."""
    out = np.zeros(at.size, np.int64)
    live = np.flatnonzero(limit > 0)
    step = np.arange(PAD)
    while live.size:
        done = out[live]
        # both ends are padded with different codes, so that reading stops there
        a = text[np.minimum(at[live] + done, text.size - PAD)[:, None] + step]
        b = query[np.minimum(start[live] + done, query.size - PAD)[:, None] + step]
        differ = a != b
        any_ = differ.any(axis=1)
        out[live] = np.minimum(done + np.where(any_, differ.argmax(axis=1), PAD), limit[live])
        live = live[~any_ & (out[live] < limit[live])]
    return out


def search(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, limit: np.ndarray, after: bool = False) -> np.ndarray:
    """Number of suffixes below the first ``limit`` codes of each query suffix, or (``after``) not above them."""
    lo, hi = np.zeros(start.size, np.int64), np.full(start.size, order.size, np.int64)
    live = np.flatnonzero(lo < hi)
    while live.size:
        mid = (lo[live] + hi[live]) // 2
        at, s, top = order[mid], start[live], limit[live]
        n = common(text, at, query, s, top)
        a, b = text[at + n], query[s + n]
        right = np.where(n >= top, after, a < b)
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def longest(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix the length of its longest match in the text, and one place of it (-1 if none)."""
    spot = search(text, order, query, start, limit)
    best, where = np.zeros(start.size, np.int64), np.full(start.size, -1, np.int64)
    for near in (spot - 1, spot):
        there = np.flatnonzero((near >= 0) & (near < order.size))
        at = order[near[there]]
        n = common(text, at, query, start[there], limit[there])
        more = n > best[there]
        best[there[more]], where[there[more]] = n[more], at[more]
    return best, where


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [lo, hi), with the number of the range each is from."""
    size = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(lo.size), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner
