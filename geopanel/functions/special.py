"""Special functions: Bessel K1 for Matern correlations, and normal, t and chi-square distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polynomial coefficients of the modified Bessel functions I1 and K1 (Abramowitz and Stegun 9.8.3, 9.8.7, 9.8.8).
_I1 = (0.5, 0.87890594, 0.51498869, 0.15084934, 0.02658733, 0.00301532, 0.00032411)
_K1_SMALL = (1.0, 0.15443144, -0.67278579, -0.18156897, -0.01919402, -0.00110404, -0.00004686)
_K1_LARGE = (1.25331414, 0.23498619, -0.03655620, 0.01504268, -0.00780353, 0.00325614, -0.00068245)


def _poly(c: tuple[float, ...], x):
    out = c[-1]
    for a in reversed(c[:-1]):
        out = out * x + a
    return out


def matern1(u: Column) -> Column:
    """u K1(u), the Matern correlation of smoothness 1 at scaled distance u; 1 at zero."""
    t = (u / 3.75) * (u / 3.75)
    i1 = u * _poly(_I1, t)
    h = (u / 2) * (u / 2)
    small = u * F.ln(u / 2) * i1 + _poly(_K1_SMALL, h)
    large = F.sqrt(u) * F.exp(-u) * _poly(_K1_LARGE, 2 / u)
    return F.when(u == 0, F.lit(1.0)).when(u <= 2, small).otherwise(large)


def bessel_k1(x: float) -> float:
    if x <= 2:
        i1 = x * _poly(_I1, (x / 3.75) ** 2)
        return math.log(x / 2) * i1 + _poly(_K1_SMALL, (x / 2) ** 2) / x
    return math.exp(-x) / math.sqrt(x) * _poly(_K1_LARGE, 2 / x)


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_tail(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile by bisection on the tail."""
    if p == 0.5:
        return 0.0
    want, lo, hi = 2 * min(p, 1 - p), 0.0, 1.0
    while t_tail(hi, df) > want:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > want else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def chi2_2_tail(x: float) -> float:
    """Upper tail of chi-square with two degrees of freedom."""
    return math.exp(-x / 2)


def omnibus(n: int, skew: float, excess: float) -> tuple[float, float]:
    """D'Agostino's K2 from biased skewness and biased excess kurtosis, and its p-value."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    delta, alpha = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2 / (w2 - 1))
    y = y if y else 1.0
    zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (excess + 3 - e) / math.sqrt(var)
    beta = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / beta * (2.0 / beta + math.sqrt(1 + 4.0 / beta**2))
    den = 1 + x * math.sqrt(2 / (a - 4.0))
    cube = math.copysign(((1 - 2.0 / a) / abs(den)) ** (1 / 3), den) if den else 0.0
    zk = (1 - 2 / (9.0 * a) - cube) / math.sqrt(2 / (9.0 * a))
    k2 = zs * zs + zk * zk
    return k2, chi2_2_tail(k2)
