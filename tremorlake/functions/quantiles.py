"""Gamma quantiles on the driver, for lookup tables over the few distinct counts of a result."""

from __future__ import annotations

import math


def _gamma_scale(a: float, x: float) -> float:
    """x^a exp(-x) / Gamma(a); for large shapes by Stirling's series, as the difference of large logarithms loses digits."""
    d = (x - a) / a
    if a < 1000 or d <= -0.5:
        return math.exp(a * math.log(x) - x - math.lgamma(a))
    return math.sqrt(a / (2 * math.pi)) * math.exp(a * (math.log1p(d) - d) - 1 / (12 * a) + 1 / (360 * a**3))


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series for small x, a continued fraction beyond."""
    if x <= 0:
        return 0.0
    scale = _gamma_scale(a, x)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    # Terms needed grow with the root of the shape.
    for i in range(1, 10_000 + 50 * math.isqrt(int(a))):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * scale


def gamma_quantile(a: float, q: float) -> float:
    low, high = 0.0, max(1.0, 2 * a)
    while gamma_cdf(a, high) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(a, mid) < q else (low, mid)
    return (low + high) / 2


def garwood(n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval of a Poisson count; at zero the upper limit is one-sided."""
    if n == 0:
        return 0.0, gamma_quantile(1.0, 1 - alpha)
    return gamma_quantile(float(n), alpha / 2), gamma_quantile(n + 1.0, 1 - alpha / 2)


def jeffreys(n: int, alpha: float = 0.05) -> tuple[float, float]:
    return gamma_quantile(n + 0.5, alpha / 2), gamma_quantile(n + 0.5, 1 - alpha / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: a continued fraction, on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    # Terms needed grow with the root of the larger shape.
    for m in range(1, 1000 + 10 * math.isqrt(int(max(a, b)))):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h / a * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))


def negative_binomial_quantile(r: float, p: float, q: float) -> int:
    """Smallest count whose cumulative probability reaches q, for a real shape r and any mean.

    The probability of at most k is an incomplete beta function, so the count is found by halving.
    """
    if not 0 <= q < 1 or p <= 0:
        raise ValueError(f"no quantile {q} of a negative binomial of probability {p}")
    # A probability that is q but for rounding reaches it.
    upto = lambda k: beta_cdf(r, k + 1.0, p) * (1 + 1e-10)
    if r <= 0 or p >= 1 or upto(0) >= q:
        return 0
    low, high = 0, max(1, int(r * (1 - p) / p))
    while upto(high) < q:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if upto(mid) < q else (low, mid)
    return high
