"""Bottom-k sketches: the least hashes of a set, and what two of them say about the Jaccard index of their sets."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Chance that a pair at the threshold is below the bound of its estimate.
LOSS = 1e-9
#: Values of a sketch that travels with its node: the high halves of the least hashes, 4 bytes each.
LARGE = 512


@cache
def least_matches(k: int, percent: int) -> int:
    """The most matches among k sampled values that a pair at the threshold has but for a chance of ``LOSS``."""
    share, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if below > LOSS:
            return m
    return k


def high_halves(values: np.ndarray) -> np.ndarray:
    """The sketch of ``LARGE`` values of a sorted set of 64-bit hashes.  Equal halves of different hashes can only add matches."""
    return np.unique((values[:LARGE] >> np.uint64(32)).astype(np.uint32))


def similar(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> tuple[bool, bool]:
    """Whether two sketches allow the similarity of their sets, and whether they show it.

    Sketches that are whole sets settle the question, but for equal halves:
    it is shown only where it would hold with two matches less.
    """
    if 100 * min(size_a, size_b) < percent * max(size_a, size_b):
        return False, False
    both = np.intersect1d(a, b, assume_unique=True)
    if a.size == size_a and b.size == size_b:
        union = size_a + size_b - both.size
        return 100 * both.size >= percent * union, 100 * (both.size - 2) >= percent * (union + 2)
    k = min(x.size for x, size in ((a, size_a), (b, size_b)) if x.size < size)
    # The least k values of the union: those up to its k-th, which both sketches cover.
    last = np.union1d(a, b)[k - 1]
    return int(np.searchsorted(both, last, side="right")) >= least_matches(k, percent), False
