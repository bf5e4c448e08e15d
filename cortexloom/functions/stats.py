"""Distribution functions and p-value combinations on numpy arrays, without scipy."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.full(x.shape, np.nan)
    ok = ~np.isnan(x)
    out[ok] = _erfc(x[ok]).astype(float)
    return out


def norm_sf(x) -> np.ndarray:
    return 0.5 * erfc(np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p) -> np.ndarray:
    """Quantile of the standard normal, by Halley steps on erfc from a rational start."""
    p = np.asarray(p, float)
    upper = p > 0.5
    q = np.where(upper, 1 - p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(q))
        x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
        for _ in range(3):
            err = norm_sf(-x) - q
            step = err * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
            x = np.where(np.isfinite(step), x - step / (1 + x * step / 2), x)
    x = np.where(q == 0, -np.inf, x)
    return np.where(upper, -x, x)


def chi2_sf(x, df: float = 1) -> np.ndarray:
    """Upper tail of chi-square."""
    x = np.asarray(x, float)
    if df == 1:
        return erfc(np.sqrt(np.maximum(x, 0) / 2)) + 0 * x
    return gamma_q(df / 2, np.maximum(x, 0) / 2)


def chi2_isf(p) -> np.ndarray:
    """Value whose upper tail of chi-square with one degree of freedom is p."""
    return norm_ppf(np.asarray(p, float) / 2) ** 2


def _gamma_q(a: float, x: float) -> float:
    if math.isnan(a) or math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def gamma_q(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    return np.vectorize(_gamma_q, otypes=[float])(a, x)


def _beta_cf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for all x until each has settled."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    out, open_ = np.ones_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + num * d)
            c = away(1 + num / c)
            h = h * d * c
        going = np.abs(d * c - 1) > 3e-16
        if not going.all():
            out[open_[~going]] = h[~going]
            open_, x, c, d, h = open_[going], x[going], c[going], d[going], h[going]
            if not len(x):
                return out
    out[open_] = h
    return out


def beta_inc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function of an array."""
    x = np.asarray(x, float)
    out = np.where(np.isnan(x), np.nan, (x >= 1).astype(float))
    inside = (x > 0) & (x < 1)
    v = x[inside]
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(v) + b * np.log1p(-v))
    low = v < (a + 1) / (a + b + 2)
    got = np.empty_like(v)
    got[low] = front[low] * _beta_cf(a, b, v[low]) / a
    got[~low] = 1 - front[~low] * _beta_cf(b, a, 1 - v[~low]) / b
    out[inside] = got
    return out


def t_sf2(t, df: float) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t = np.asarray(t, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def beta_pdf(x, a: float, b: float) -> np.ndarray:
    x = np.asarray(x, float)
    if (a, b) == (1, 1):
        return np.ones_like(x)
    return np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * x ** (a - 1) * (1 - x) ** (b - 1)


def cauchy_combination(p, weights=None) -> np.ndarray:
    """Combine p-values along the first axis by the Cauchy statistic (O-184).

    Columns with a NaN, or with both a 0 and a 1, give NaN; with a 0 they give 0, with a 1 give 1.
    Values below 1e-16 enter as weight / (p * pi); a statistic above 1e15 has tail 1 / (stat * pi).
    """
    p = np.asarray(p, float)
    flat = p.ndim == 1
    p = p[:, None] if flat else p
    if np.any((p < 0) | (p > 1)):
        raise ValueError("p-values are between 0 and 1")
    w = np.ones(len(p)) if weights is None else np.asarray(weights, float)
    if len(w) != len(p) or np.any(~(w >= 0)) or w.sum() == 0:
        raise ValueError("weights are non-negative, one for each p-value")
    w = (w / w.sum())[:, None]
    small = p < 1e-16
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(small, w / np.where(small, p, 1) / math.pi, w * np.tan((0.5 - np.where(small, 0.5, p)) * math.pi)).sum(axis=0)
        out = np.where(stat > 1e15, 1 / (stat * math.pi), 0.5 - np.arctan(stat) / math.pi)
    zero, one = (p == 0).any(axis=0), (p == 1).any(axis=0)
    out = np.where(zero & one | np.isnan(p).any(axis=0), np.nan, np.where(zero, 0.0, np.where(one, 1.0, out)))
    return out[0] if flat else out


def moment_match(q, lam: np.ndarray) -> np.ndarray:
    """Tails of a weighted sum of chi-squares by matching its first moments to one chi-square (O-182 fallback)."""
    c1, c2, c3, c4 = (float(np.sum(lam**k)) for k in (1, 2, 3, 4))
    s1, s2 = c3 / c2**1.5, c4 / c2**2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        df = a * a - 2 * (s1 * a**3 - a * a)
    else:
        df, a = 1 / s2, math.sqrt(1 / s2)
    # the noncentrality only shifts the reference chi-square, so it cancels here
    x = (np.asarray(q, float) - c1) / math.sqrt(2 * c2) * math.sqrt(2) * a + df
    return chi2_sf(x, df)


#: Values times weights that the bisection holds at a time.
SADDLE_CELLS = 1 << 20


def saddlepoint(q, lam) -> np.ndarray:
    """Upper tails at each q of the sum of chi-squares (one degree each) weighted by lam (O-182): all of them bisected together."""
    lam, q = np.sort(np.asarray(lam, float))[::-1], np.asarray(q, float)
    flat, out = q.ravel(), np.full(q.size, np.nan)
    if len(lam) and lam[0] > 0:
        step = max(1, SADDLE_CELLS // len(lam))
        for k in range(0, len(flat), step):
            own = flat[k : k + step]
            usable = ~np.isnan(own)
            out[k : k + step][usable] = _saddlepoint(np.where(own > 0, own, 1e-4)[usable], lam)
    return out.reshape(q.shape)


def saddlepoint_rows(q: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The same for values of many sums together: q rows x values, lam rows x weights."""
    out = np.full(q.size, np.nan)
    lam, flat, of = np.sort(np.asarray(lam, float), axis=1)[:, ::-1], np.asarray(q, float).ravel(), np.repeat(np.arange(len(q)), q.shape[1])
    usable = np.flatnonzero(~np.isnan(flat) & (lam[:, 0] > 0)[of]) if lam.size else np.zeros(0, int)
    step = max(1, SADDLE_CELLS // max(1, lam.shape[1]))
    for k in range(0, len(usable), step):
        own = usable[k : k + step]
        out[own] = _saddlepoint(np.where(flat[own] > 0, flat[own], 1e-4), lam[of[own]])
    return out.reshape(q.shape)


def _saddlepoint(q: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """lam: falling weights, of all q or a row for each."""
    lam = np.broadcast_to(lam, (len(q), lam.shape[-1]))
    scale = lam[:, 0]
    whole, plain = q, lam
    q, lam = q / scale, lam / scale[:, None]
    low, high = np.where(q > lam.sum(axis=1), -0.01, -lam.shape[1] / (2 * q)), np.full(len(q), 0.499995)
    for _ in range(30):
        x = (low + high) / 2
        above = (lam / (1 - 2 * lam * x[:, None])).sum(axis=1) > q
        low, high = np.where(above, low, x), np.where(above, x, high)
    x = (low + high) / 2
    left = 1 - 2 * lam * x[:, None]
    inner = 2 * (x * q + 0.5 * np.log(left).sum(axis=1))
    matched = (np.abs(x) < 1e-4) | (inner <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.copysign(np.sqrt(np.where(matched, 1, inner)), x)
        v = x * np.sqrt((2 * lam**2 / left**2).sum(axis=1))
        out = norm_sf(w + np.log(v / w) / w)
    for k in np.flatnonzero(matched):
        out[k] = moment_match(whole[k], plain[k])
    return out


def hwe_exact(hom: int, het: int, alt: int, mid: bool = True) -> float:
    """Exact test of Hardy-Weinberg proportions from genotype counts; mid-p unless told otherwise (O-104)."""
    n = hom + het + alt
    rare = 2 * min(hom, alt) + het
    if n == 0 or rare == 0:
        return 1.0
    start = rare * (2 * n - rare) // (2 * n)
    start += (start + rare) % 2
    probs = {start: 1.0}
    h, r, c, p = start, (rare - start) // 2, n - start - (rare - start) // 2, 1.0
    while h >= 2:
        p *= h * (h - 1) / (4 * (r + 1) * (c + 1))
        h, r, c = h - 2, r + 1, c + 1
        probs[h] = p
    h, r, c, p = start, (rare - start) // 2, n - start - (rare - start) // 2, 1.0
    while h <= rare - 2:
        p *= 4 * r * c / ((h + 2) * (h + 1))
        h, r, c = h + 2, r - 1, c - 1
        probs[h] = p
    total, own = sum(probs.values()), probs[het]
    if mid:
        return min(1.0, (sum(v for v in probs.values() if v < own * (1 - 1e-12)) + sum(v for v in probs.values() if abs(v - own) <= own * 1e-12) / 2) / total)
    return min(1.0, sum(v for v in probs.values() if v <= own * (1 + 1e-12)) / total)
