"""Tail probabilities as numpy kernels and Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.asarray(_erfc(np.abs(np.asarray(z, float)) / math.sqrt(2)), float)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (lgamma(p) + lgamma(q) - lgamma(p + q))) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(swap, 1 - front * h, front * h)
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(df > 0, incomplete_beta(df / 2, 0.5, df / (df + t * t)), np.nan)


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_tails(k: np.ndarray, population: np.ndarray, successes: np.ndarray, draws: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """P(X >= k) where ``upper``, else P(X <= k); 1 where nothing is drawn or nothing can succeed.

    Terms are summed away from the mode, each from the one before, until they no longer count; a tail
    that holds the mode is 1 less the other one. So a row costs some tens of terms, whatever its sizes.
    """
    k, m, s, d = (np.asarray(x, float) for x in (k, population, successes, draws))
    upper = np.asarray(upper, bool)
    low, high, mode = np.maximum(0, d - (m - s)), np.minimum(s, d), np.floor((d + 1) * (s + 1) / (m + 2))
    other = np.where(upper, k <= mode, k >= mode)
    up = upper != other
    at = np.where(other, np.where(upper, k - 1, k + 1), k)
    rows = np.flatnonzero((at >= low) & (at <= high))
    total = np.zeros(len(k))
    i, m, s, d, high, low, up_ = at[rows], m[rows], s[rows], d[rows], high[rows], low[rows], up[rows]
    term = np.exp(log_choose(s, i) + log_choose(m - s, d - i) - log_choose(m, d))
    total[rows] = term
    while len(rows):
        ends = np.where(up_, i >= high, i <= low) | (term <= 1e-18 * total[rows])
        if ends.any():
            rows, i, m, s, d, high, low, up_, term = (x[~ends] for x in (rows, i, m, s, d, high, low, up_, term))
        rest = m - s - d + i
        above, below = np.where(up_, (s - i) * (d - i), i * rest), np.where(up_, (i + 1) * (rest + 1), (s - i + 1) * (d - i + 1))
        term = term * (above / below)
        i = np.where(up_, i + 1, i - 1)
        total[rows] += term
    total = np.clip(total, 0, 1)
    return np.where(other, 1 - total, total)


def hypergeometric(k: int, population: int, successes: int, draws: int, upper: bool = True) -> float:
    """P(X >= k), or P(X <= k); 1 where nothing is drawn or nothing can succeed."""
    return float(hypergeometric_tails([k], [population], [successes], [draws], [upper])[0])


def _wrapped(kernel):
    @F.pandas_udf("double")
    def of_two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(kernel(x.to_numpy(float), y.to_numpy(float))).where(x.notna().to_numpy() & y.notna().to_numpy())

    return of_two


def normal_p(z: Column) -> Column:
    """Two-sided normal p; null for null."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(x.to_numpy(float))).where(x.notna())

    return p(z)


def t_p(t: Column, df: Column) -> Column:
    return _wrapped(t_two_sided)(t, df)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation of n pairs."""
    return t_p(r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r)), (n - 2).cast("double"))


def hypergeometric_p(k: Column, population: Column, successes: Column, draws: Column, two_tails: bool = False) -> Column:
    """Upper tail; with ``two_tails`` the lower one where fewer than expected are found."""

    @F.pandas_udf("double")
    def p(k: pd.Series, m: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"k": k, "m": m, "s": s, "d": d}).astype(float)
        good = (rows.notna().all(axis=1) & (rows.m > 0) & (rows.s >= 0) & (rows.d >= 0) & (rows.s <= rows.m) & (rows.d <= rows.m)).to_numpy()
        out = np.full(len(rows), np.nan)
        k, m, s, d = rows[good].to_numpy().T
        out[good] = hypergeometric_tails(k, m, s, d, k * m >= s * d if two_tails else np.ones(len(k), bool))
        return pd.Series(out).where(good)

    return p(k, population, successes, draws)


def empirical_hypergeometric_p(key: Column, k: Column, population: Column, successes: Column, draws: Column, n: int = 10_000, seed: int = 42) -> Column:
    """(1 + draws at least k) / (1 + n) of seeded random draws; the key makes each row's own stream."""

    @F.pandas_udf("double")
    def p(key: pd.Series, k: pd.Series, m: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        import zlib

        out = []
        for name, a, b, c, e in zip(key, k, m, s, d):
            rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
            out.append((1 + int((rng.hypergeometric(int(c), int(b - c), int(e), n) >= a).sum())) / (1 + n))
        return pd.Series(out)

    return p(key.cast("string"), k, population, successes, draws)


def register(spark: SparkSession) -> None:
    """Make the kernels available to SQL as normal_p, t_p and hypergeometric_p."""

    @F.pandas_udf("double")
    def hyper(k: pd.Series, m: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_tails(k, m, s, d, np.ones(len(k), bool)))

    @F.pandas_udf("double")
    def normal(z: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(z.to_numpy(float)))

    spark.udf.register("normal_p", normal)
    spark.udf.register("t_p", _wrapped(t_two_sided))
    spark.udf.register("hypergeometric_p", hyper)
