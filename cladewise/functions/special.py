"""Special functions over numpy arrays, used inside grouped functions."""

from __future__ import annotations

import math

import numpy as np


def regularised_incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - regularised_incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_t_two_sided(t: float, df: float) -> float:
    return regularised_incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def regularised_lower_gamma(a: float, x: float) -> float:
    """P(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, shape: float, rate: float) -> float:
    """By bisection on the distribution function."""
    lo, hi = 0.0, max(1.0, shape)
    while regularised_lower_gamma(shape, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if regularised_lower_gamma(shape, mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2 / rate


def discrete_gamma(alpha: float, categories: int) -> np.ndarray:
    """Rates at the midpoint quantiles, scaled to mean 1."""
    q = np.array([gamma_quantile((2 * k + 1) / (2 * categories), alpha, alpha) for k in range(categories)])
    return q / q.mean()


def chi2_tail(x: float, df: float) -> float:
    return 1 - regularised_lower_gamma(df / 2, x / 2) if x > 0 else 1.0


def golden_section(f, lo: float, hi: float, tolerance: float = 1e-9, steps: int = 400) -> tuple[float, float]:
    """(x, f(x)) of the maximum in an interval; the smaller x of ties."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if hi - lo <= tolerance:
            break
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    tried = [(f(x), -x) for x in (lo, (lo + hi) / 2, hi)]
    best = max(tried)
    return -best[1], best[0]
