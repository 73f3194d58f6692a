"""Tail probabilities and quantiles of the normal, t, F and chi-square distributions, in plain floating point."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def _stirling(x: float) -> float:
    """ln Gamma(x) less its Stirling approximation, for x of 10 or more."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x


def log_beta(a: float, b: float) -> float:
    """ln B(a, b) without the cancellation that differences of ln Gamma have for large arguments."""
    a, b = min(a, b), max(a, b)
    if a >= 10:
        rest = _stirling(a) + _stirling(b) - _stirling(a + b)
        return -0.5 * math.log(b) + 0.5 * math.log(2 * math.pi) + (a - 0.5) * math.log(a / (a + b)) - b * math.log1p(a / b) + rest
    if b >= 10:
        rest = _stirling(b) - _stirling(a + b)
        return math.lgamma(a) + rest + a - a * math.log(a + b) - (b - 0.5) * math.log1p(a / b)
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 20000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + top / c
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function; y is 1 - x where the caller has it exactly."""
    y = 1 - x if y is None else y
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    log_x, log_y = math.log1p(-y) if y < 0.5 else math.log(x), math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(a * log_x + b * log_y - log_beta(a, b))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, y) / b


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    out = d
    for i in range(1, 100000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + top / c
        c = c if abs(c) > _TINY else _TINY
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def norm_sf2(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2)) if z == z else math.nan


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_sf2(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if t != t:
        return math.nan
    if math.isinf(t):
        return 0.0
    s = t * t
    if df > 1e7 and s < 1e4:  # the continued fraction cancels there; Fisher's expansion to the normal is exact to its last digits
        return norm_sf2(t * (1 - (s + 1) / (4 * df) + (13 * s * s + 8 * s + 3) / (96 * df * df)))
    return beta_inc(df / 2, 0.5, df / (df + s), s / (df + s))


def t_ppf(p: float, df: float) -> float:
    """Quantile by Newton steps on the tail, kept inside a bracket."""
    if p == 0.5:
        return 0.0
    tail = 2 * min(p, 1 - p)
    lo, hi = 0.0, 2.0
    while t_sf2(hi, df) > tail:
        lo, hi = hi, hi * 2
    x = min(max(norm_ppf(1 - tail / 2), lo), hi)
    for _ in range(200):
        gap = t_sf2(x, df) - tail
        lo, hi = (x, hi) if gap > 0 else (lo, x)
        log_density = -0.5 * math.log(df) - log_beta(df / 2, 0.5) - (df + 1) / 2 * math.log1p(x * x / df)
        step = gap / (2 * math.exp(log_density))
        fresh = x + step
        if not lo < fresh < hi:
            fresh = (lo + hi) / 2
        if abs(fresh - x) <= 1e-15 * max(1.0, abs(x)):
            x = fresh
            break
        x = fresh
    return x if p > 0.5 else -x


def f_sf(f: float, d1: float, d2: float) -> float:
    if f != f:
        return math.nan
    if f <= 0:
        return 1.0
    if d1 == 1:
        return t_sf2(math.sqrt(f), d2)
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    if x != x or df <= 0:
        return math.nan
    return gamma_q(df / 2, x / 2)
