"""Special functions on numpy arrays: incomplete gamma and beta, and their inverses."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def gamma_inc(a, x):
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 0.0
    out[ok & np.isinf(x)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        p, q = a[low], x[low]
        term = total = 1 / p
        n = p.copy()
        for _ in range(2000):
            n = n + 1
            term = term * q / n
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-16).all():
                break
        out[low] = total * np.exp(-q + p * np.log(q) - _lgamma(p))
    high = ok & (x >= a + 1) & ~np.isinf(x)
    if high.any():
        p, q = a[high], x[high]
        b = q + 1 - p
        c, d = np.full(p.shape, 1 / _TINY), 1 / b
        h = d
        for i in range(1, 2000):
            an = -i * (i - p)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - h * np.exp(-q + p * np.log(q) - _lgamma(p))
    return out


def beta_inc(a, b, x):
    """Regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1) & (p > 0) & (q > 0)
    zz = np.where(inside, z, 0.5)
    c, d = np.ones(p.shape), 1 - (p + q) * zz / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d
    for m in range(1, 1000):
        for num in (m * (q - m) * zz / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * zz / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
        if (np.abs(step - 1)[inside] < 1e-15).all():
            break
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zz) + q * np.log1p(-zz)) / p
    got = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(flip, 1 - got, got)


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def invert(cdf, p, low, high, steps: int = 200):
    """The x where an increasing cdf reaches p, by bisection; infinite ends are first brought in by doubling."""
    p = np.asarray(p, float)
    lo = np.where(np.isinf(low), -1.0, low) * np.ones(p.shape)
    hi = np.where(np.isinf(high), 1.0, high) * np.ones(p.shape)
    with np.errstate(all="ignore"):
        for _ in range(1100):
            below = np.isinf(low) & (cdf(lo) > p)
            above = np.isinf(high) & (cdf(hi) < p)
            if not (below.any() or above.any()):
                break
            lo, hi = np.where(below, lo * 2, lo), np.where(above, hi * 2, hi)
        for _ in range(steps):
            mid = (lo + hi) / 2
            less = cdf(mid) < p
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    out = (lo + hi) / 2
    out = np.where(p == 0, low, np.where(p == 1, high, out))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, out)
