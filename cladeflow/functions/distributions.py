"""Tail probabilities on numpy arrays: normal, Student t, binomial, and the exact null distributions of rank correlations."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import permutations

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    return _erfc(np.asarray(z, float) / math.sqrt(2)) / 2


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function I_x(a, b), by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    todo = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if not todo.any():
        return out
    a, b, x = a[todo], b[todo], x[todo]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 20_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = np.clip(front * f, 0, 1)
    out[todo] = np.where(swap, 1 - value, value)
    return out


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's distribution."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(over="ignore", invalid="ignore"):
        half = beta_inc(df / 2, np.full(df.shape, 0.5), np.where(np.isinf(t), 0.0, df / (df + t * t))) / 2
    return np.where(t >= 0, half, 1 - half)


def binom_lower(k: np.ndarray, n: np.ndarray, p: float = 0.5) -> np.ndarray:
    """P(X <= k) of n trials."""
    k, n = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float))
    inner = (k >= 0) & (k < n)
    out = np.where(k < 0, 0.0, 1.0)
    out[inner] = beta_inc(n[inner] - k[inner], k[inner] + 1, np.full(int(inner.sum()), 1 - p))
    return out


# Coefficients of the published series for Spearman's S (algorithm AS 89).
_EDGEWORTH = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)


@lru_cache(maxsize=16)
def _spearman_counts(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the sum of squared rank differences over all permutations of n, sorted, and counts up to each."""
    base = np.arange(n)
    sums = np.fromiter((sum((i - x) ** 2 for i, x in zip(range(n), p)) for p in permutations(range(n))), np.int64) if n < 8 else _spearman_sums(n, base)
    values, counts = np.unique(sums, return_counts=True)
    return values, np.cumsum(counts)


def _spearman_sums(n: int, base: np.ndarray) -> np.ndarray:
    table = np.zeros((1, 0), np.int8)
    for i in range(n):  # each row a permutation of i elements; the next is put at every place
        table = np.concatenate([np.insert(table, j, i, axis=1) for j in range(i + 1)])
    return ((table.astype(np.int64) - base) ** 2).sum(1)


def spearman_upper(s: float, n: int) -> float:
    """P(S >= s) without ties: over all permutations up to n = 9, by the series beyond."""
    if n <= 9:
        values, upto = _spearman_counts(n)
        i = int(np.searchsorted(values, s, side="left"))
        return 1.0 - (upto[i - 1] / upto[-1] if i else 0.0)
    return spearman_series(s, n)


def spearman_series(s: float, n: int) -> float:
    """P(S >= s) without ties, by the series."""
    c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12 = _EDGEWORTH
    b = 1 / n
    x = (6 * (s - 1) * b / (n * n - 1) - 1) * math.sqrt(1 / b - 1)
    y = x * x
    u = x * b * (c1 + b * (c2 + c3 * b) + y * (-c4 + b * (c5 + c6 * b) - y * b * (c7 + c8 * b - y * (c9 - c10 * b + y * b * (c11 - c12 * y)))))
    return min(1.0, max(0.0, u / math.exp(y / 2) + float(norm_upper(np.array(x)))))


def spearman_p(rho: float, n: int, alternative: str) -> float:
    """Exact p-value of Spearman's rho without ties."""
    s = round((n**3 - n) * (1 - rho) / 6)
    upper, lower = spearman_upper(s, n), 1 - spearman_upper(s + 2, n)  # P(S >= s), P(S <= s): S is even
    if alternative == "greater":
        return lower
    if alternative == "less":
        return upper
    return min(1.0, 2 * (upper if s > (n**3 - n) / 6 else lower))


@lru_cache(maxsize=64)
def _kendall_counts(n: int) -> np.ndarray:
    """Share of permutations of n with up to k concordant pairs, for each k."""
    counts = np.ones(1)
    for i in range(2, n + 1):
        counts = np.convolve(counts, np.ones(i) / i)
    return np.cumsum(counts)


def kendall_exact_p(tau: float, n: int, alternative: str) -> float:
    q = round((tau + 1) * n * (n - 1) / 4)
    upto = _kendall_counts(n)
    lower = float(upto[q]) if q < len(upto) else 1.0
    upper = 1 - float(upto[q - 1]) if q > 0 else 1.0
    return {"less": lower, "greater": upper}.get(alternative, min(1.0, 2 * min(lower, upper)))


def kendall_sum(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Sum over all pairs of points of the product of their weights and of the signs of their differences in a and in b.

    Points are put in order of a (and b) and counted block against block, blocks doubling until one is left.
    """
    order = np.lexsort((b, a))
    a, b, w = a[order], np.unique(b[order], return_inverse=True)[1].astype(np.int64), w[order].astype(float)
    n, kinds, total, size = len(a), int(b.max()) + 1 if len(b) else 1, 0.0, 1
    # points of equal a stand in order of b and are counted below as rising; they are taken off again
    ends = lambda *v: np.flatnonzero(np.r_[np.any([x[1:] != x[:-1] for x in v], 0), True])
    if n:
        upto = np.cumsum(w)
        per_a, per_ab = np.diff(np.r_[0.0, upto[ends(a)]]), np.diff(np.r_[0.0, upto[ends(a, b)]])
        total -= ((per_a**2).sum() - (per_ab**2).sum()) / 2
    while size < n:
        block = np.arange(n) // size
        right = block % 2 == 1
        pair = block // 2
        key = pair * kinds + b
        lk, lw = key[~right], np.r_[0.0, np.cumsum(w[~right])]
        rk, rp = key[right], pair[right]
        below = lw[np.searchsorted(lk, rk, "left")] - lw[np.searchsorted(lk, rp * kinds, "left")]
        above = lw[np.searchsorted(lk, (rp + 1) * kinds, "left")] - lw[np.searchsorted(lk, rk, "right")]
        total += float((w[right] * (below - above)).sum())
        order = np.argsort(key, kind="stable")
        b, w = b[order], w[order]
        size *= 2
    return total


def kendall_p(tau: float, s: float, n: int, tied: bool, spread: tuple[float, float], pairs: tuple[float, float], triples: tuple[float, float], alternative: str, exact: bool | None, continuity: bool) -> float:
    """p-value of tau-b: exact below 50 values without ties, else by the normal approximation.

    For both sides ``spread`` is the sum over ties of t (t - 1) (2 t + 5), ``pairs`` of t (t - 1), ``triples`` of t (t - 1) (t - 2).
    """
    if (n < 50 if exact is None else exact) and not tied:
        return kendall_exact_p(tau, n, alternative)
    var = (n * (n - 1) * (2 * n + 5) - sum(spread)) / 18 + pairs[0] * pairs[1] / (2 * n * (n - 1))
    if n > 2:
        var += triples[0] * triples[1] / (9 * n * (n - 1) * (n - 2))
    if continuity:
        s = math.copysign(max(abs(s) - 1, 0), s)
    upper = float(norm_upper(np.array(s / math.sqrt(var))))
    return {"greater": upper, "less": 1 - upper}.get(alternative, min(1.0, 2 * min(upper, 1 - upper)))
