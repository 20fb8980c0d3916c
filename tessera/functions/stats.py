"""The incomplete beta function, and what binomial tails and intervals take from it."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), the share of a beta(a, b) variable at or below x, by a continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * value)


def beta_quantile(share: float, a: float, b: float) -> float:
    """x with I_x(a, b) = share, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < share else (lo, mid)
    return (lo + hi) / 2


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial variable of n trials."""
    return 1.0 if k <= 0 else 0.0 if k > n else incomplete_beta(k, n - k + 1, p)


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson: where the tail at k reaches alpha / 2 on either side; (0, 1) without trials."""
    return (beta_quantile(alpha / 2, k, n - k + 1) if k else 0.0), (beta_quantile(1 - alpha / 2, k + 1, n - k) if k < n else 1.0)
