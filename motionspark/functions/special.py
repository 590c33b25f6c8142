"""Distribution functions in NumPy, for the few rows of test results."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_cdfs(z: np.ndarray) -> np.ndarray:
    """The same for many values; each different one is computed once."""
    values, at = np.unique(z, return_inverse=True)
    return np.fromiter(map(normal_cdf, values), float, len(values))[at]


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def rank_sum_exact(u: float, n: int, blocks: list[int]) -> float:
    """Two-sided p of Mann-Whitney's U of a group of ``n`` values, given the sizes of the blocks of equal values of both groups in
    order: twice the smaller tail of the exact distribution of the sum of mid-ranks. ``ways[k, w]`` counts how k values can be
    taken from the blocks so far with a sum of doubled mid-ranks w; doubled, mid-ranks are whole numbers."""
    whole = sum(blocks)
    most = 2 * n * whole
    ways = np.zeros((n + 1, most + 1), np.int64)  # up to 60 values: all of them can be taken in fewer than 2^63 ways
    ways[0, 0] = 1
    before = 0
    for t in blocks:
        rank = 2 * before + t + 1
        new = np.zeros_like(ways)
        for j in range(min(t, n) + 1):
            new[j:, j * rank :] += math.comb(t, j) * ways[: n + 1 - j, : most + 1 - j * rank]
        ways, before = new, before + t
    seen, row = round(2 * u) + n * (n + 1), ways[n]
    tail = min(int(row[: seen + 1].sum()), int(row[seen:].sum()))
    return min(1.0, 2 * tail / math.comb(whole, n))


def spearman_exact(x: list[float], y: list[float]) -> float:
    """Two-sided p of the rank correlation of the mid-ranks ``x`` and ``y`` of a few rows: the share of all orders of ``y`` whose sum of
    products is at least as far on the same side, doubled. Orders are counted by the products that the rows so far make, for
    each set of ranks that they use; doubled, mid-ranks are whole numbers."""
    a, b = ([round(2 * v) for v in r] for r in (x, y))
    n, seen = len(a), sum(v * w for v, w in zip(a, b, strict=True))
    sums: dict[int, dict[int, int]] = {0: {0: 1}}
    for v in a:
        more: dict[int, dict[int, int]] = {}
        for used, own in sums.items():
            for k in range(n):
                if not used >> k & 1:
                    to = more.setdefault(used | 1 << k, {})
                    for s, count in own.items():
                        to[s + v * b[k]] = to.get(s + v * b[k], 0) + count
        sums = more
    own = sums[(1 << n) - 1]
    tail = min(sum(c for s, c in own.items() if s >= seen), sum(c for s, c in own.items() if s <= seen))
    return min(1.0, 2 * tail / math.factorial(n))
