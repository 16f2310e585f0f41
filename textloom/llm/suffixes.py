"""Suffix arrays over word ids in numpy: prefix doubling, common prefixes, binary search."""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``ids`` in order, and the ranks by their first 1, 2, 4, ... ids.

    Records have to end with an id that occurs once, so that no two suffixes are
    equal and no common prefix crosses a record. With ``depth`` the order is
    settled up to that many ids only.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), []
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while rank.max() < n - 1 and (depth is None or width < depth):
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        ranks.append(rank)
        width *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """For each place but the first, the number of ids its suffix shares with the one before."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        lcp[1:][same] += width
        a[same] += width
        b[same] += width
    return lcp


def _compare(ids: np.ndarray, starts: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the suffix at ``starts`` against the first ``lengths`` ids of each pattern; -1 also past the end."""
    places = starts[:, None] + np.arange(patterns.shape[1])
    window = np.where(places < len(ids), ids[np.minimum(places, len(ids) - 1)], -1)
    differ = (window != patterns) & (np.arange(patterns.shape[1]) < lengths[:, None])
    first = differ.argmax(1)
    row = np.arange(len(starts))
    sign = np.sign(window[row, first] - patterns[row, first])
    return np.where(differ.any(1), sign, 0)


def search(ids: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every pattern at once: the interval of ``order`` whose suffixes begin with it."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = _compare(ids, order[middle], patterns[open_], lengths[open_])
            right = (sign <= 0) if upper else (sign < 0)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        bounds.append(low)
    return bounds[0], bounds[1]
