"""Iterative and resampling kernels: numpy on blocks of genes, a block of a group a task.

Every function takes long rows (group keys, gene, sample, value) and cuts the genes of a group into
blocks of about ``BLOCK_GENES`` by hash, and of fewer where these have more than ``BLOCK_ROWS`` rows,
so a task holds a block times the group's samples and no more: a gene's samples at the least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.functions.pvalues import normal_two_sided, t_two_sided

#: Genes of a block, about; the number of blocks follows from the number of genes.
BLOCK_GENES = 32
#: Rows of a block, about; and of shuffled labels, those that are held at once.
BLOCK_ROWS, MASK_VALUES = 500_000, 4_000_000


def _blocked(df: DataFrame, keys: list[str], gene: str, *values: str):
    """Groups of the keys and a block; of other columns the ``values`` alone are sent."""
    per = df.groupBy(gene).agg(F.count("*").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-per[0] // BLOCK_GENES), min(per[0], -(-per[1] // BLOCK_ROWS)))
    return df.select(*keys, gene, *values).withColumn("__block", F.pmod(F.xxhash64(gene), F.lit(blocks))).groupBy(*keys, "__block")


def _schema(df: DataFrame, keys: list[str], gene: str, rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in [*keys, gene]) + ", " + rest


def _matrix(pdf: pd.DataFrame, gene: str) -> tuple[pd.DataFrame, np.ndarray]:
    wide = pdf.pivot_table(index="sample", columns=gene, values="value", aggfunc="first")
    return wide, pdf.drop_duplicates("sample").set_index("sample").loc[wide.index, "status"].to_numpy(float)


def logistic_fits(x: np.ndarray, y: np.ndarray, kind: str, rounds: int = 50, ridge: float = 1e-8, sd: tuple[float, float] = (10.0, 2.5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, its error and convergence of logit(y) = a + b x for every column of ``x`` at once.

    ``weighted`` gives both classes equal weight, ``firth`` penalises by the information's root,
    ``bayes`` has normal priors of deviations ``sd`` and equal class weights; errors are from the
    curvature at the end.
    """
    n, m = x.shape
    w = np.ones(n)
    if kind in ("weighted", "bayes"):
        w = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    prior = np.array([1 / sd[0] ** 2, 1 / sd[1] ** 2]) if kind == "bayes" else np.zeros(2)
    a, b, done = np.zeros(m), np.zeros(m), np.zeros(m, bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = w[:, None] * p * (1 - p)
        i00, i01, i11 = v.sum(0) + prior[0] + ridge, (v * x).sum(0), (v * x * x).sum(0) + prior[1] + ridge
        det = i00 * i11 - i01 * i01
        res = w[:, None] * (y[:, None] - p)
        if kind == "firth":
            hat = v * (i11 - 2 * i01 * x + i00 * x * x) / det
            res = res + hat * (0.5 - p)
        g0, g1 = res.sum(0) - prior[0] * a, (res * x).sum(0) - prior[1] * b
        da, db = (i11 * g0 - i01 * g1) / det, (i00 * g1 - i01 * g0) / det
        size = np.maximum(1.0, np.maximum(np.abs(da), np.abs(db)) / 5)
        a, b = a + da / size, b + db / size
        done = np.maximum(np.abs(da), np.abs(db)) < 1e-8
        if done.all():
            break
    return b, np.sqrt(i00 / det), done


def logistic(df: DataFrame, keys: list[str], kind: str, gene: str = "gene") -> DataFrame:
    """Per gene the log odds a value, error, z, p and (``bayes``) the 95 % interval; constant genes are left out.

    Rows: keys, gene, sample, value, status (0/1). ``kind`` is weighted, firth or bayes.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, y = _matrix(pdf, gene)
        values = wide.fillna(0.0)
        values = values.loc[:, values.std(axis=0, ddof=0) > 1e-10]
        ok = len(set(y)) == 2 and values.shape[1] > 0
        if not ok:
            return pd.DataFrame(columns=[*keys, gene, "log_or", "se", "z", "p", "ci_low", "ci_high", "converged"], dtype=object)
        b, se, done = logistic_fits(values.to_numpy(float), y, kind, 100 if kind == "firth" else 50)
        out = pd.DataFrame({gene: np.array(values.columns, dtype=object), "log_or": b, "se": se, "z": b / se, "converged": done})
        out["p"], out["ci_low"], out["ci_high"] = normal_two_sided(out["z"].to_numpy(float)), out["log_or"] - 1.96 * out["se"], out["log_or"] + 1.96 * out["se"]
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, gene, "log_or", "se", "z", "p", "ci_low", "ci_high", "converged"]]

    return _blocked(df, keys, gene, "sample", "value", "status").applyInPandas(fit, _schema(df, keys, gene, "log_or double, se double, z double, p double, ci_low double, ci_high double, converged boolean"))


def permutation_test(df: DataFrame, keys: list[str], reps: int = 1000, seed: int = 42, gene: str = "gene") -> DataFrame:
    """Mean difference of cases and controls against ``reps`` shuffles of the labels: (b + 1) / (reps + 1).

    All genes of a group meet the same shuffles, drawn from the seed and the ordered samples.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, y = _matrix(pdf, gene)
        x, case = wide.fillna(0.0).to_numpy(float), y == 1
        n1, n0 = case.sum(), (~case).sum()
        if not n1 or not n0:
            return pd.DataFrame(columns=[*keys, gene, "difference", "p"], dtype=object)
        rng = np.random.default_rng(seed)
        total = x.sum(axis=0)
        diff = lambda mask: (mask @ x) / n1 - (total - mask @ x) / n0
        seen = diff(case.astype(float))
        hits, step = np.zeros(x.shape[1], int), max(1, MASK_VALUES // len(case))
        for first in range(0, reps, step):
            masks = np.stack([rng.permutation(case) for _ in range(first, min(reps, first + step))]).astype(float)
            hits += (np.abs(diff(masks)) >= np.abs(seen) - 1e-12).sum(axis=0)
        out = pd.DataFrame({gene: np.array(wide.columns, dtype=object), "difference": seen, "p": (hits + 1) / (reps + 1)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, gene, "difference", "p"]]

    return _blocked(df, keys, gene, "sample", "value", "status").applyInPandas(test, _schema(df, keys, gene, "difference double, p double"))


def residualised(df: DataFrame, covariates: DataFrame, keys: list[str], cols: list[str], add_mean: bool = True, gene: str = "gene") -> DataFrame:
    """Values less what an intercept and the covariates explain, per gene; missing values stay missing.

    A gap is filled by the gene's mean for the fit. ``covariates`` has one row a sample; samples
    without one are left out.
    """
    rows = df.select(*keys, gene, "sample", "value").join(covariates.select("sample", *cols), "sample")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="sample", columns=gene, values="value", aggfunc="first", dropna=False)
        c = pdf.drop_duplicates("sample").set_index("sample").loc[wide.index, cols].to_numpy(float)
        y = wide.to_numpy(float)
        gap = np.isnan(y)
        mean = np.nanmean(np.where(gap.all(axis=0), 0.0, y), axis=0)
        filled = np.where(gap, mean, y)
        x = np.column_stack([np.ones(len(c)), c])
        rest = filled - x @ (np.linalg.pinv(x) @ filled) + (filled.mean(axis=0) if add_mean else 0.0)
        out = pd.DataFrame(np.where(gap, np.nan, rest), index=wide.index, columns=wide.columns).stack(future_stack=True).rename("value").reset_index()
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, gene, "sample", "value"]]

    kinds = dict(df.dtypes)
    return _blocked(rows, keys, gene, "sample", "value", *cols).applyInPandas(fit, _schema(df, keys, gene, f"sample {kinds['sample']}, value double"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(8):
        out, x = out - 1 / x, x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(8):
        out, x = out + 1 / x**2, x + 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def _inverse_trigamma(y: float) -> float:
    x = 0.5 + 1 / y
    for _ in range(50):
        t = float(_trigamma(x))
        step = t * (1 - t / y) / ((float(_trigamma(x + 1e-5)) - float(_trigamma(x - 1e-5))) / 2e-5)
        x += step
        if abs(step / x) < 1e-10:
            break
    return x


def moderated_t(df: DataFrame, keys: list[str], gene: str = "gene", value: str = "value", status: str = "status") -> DataFrame:
    """Two-group t with variances shrunk towards the group's prior, which moments of log variances give.

    Spark makes each gene's sufficient statistics; a group's genes then meet as one row each, with
    no samples.
    """
    case, v = F.col(status) == 1, F.col(value)
    stats = df.filter(v.isNotNull()).groupBy(*keys, gene).agg(
        F.count_if(case).alias("n1"), F.count_if(~case).alias("n0"), F.avg(F.when(case, v)).alias("m1"), F.avg(F.when(~case, v)).alias("m0"),
        F.coalesce(F.var_samp(F.when(case, v)), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(F.when(~case, v)), F.lit(0.0)).alias("v0"),
    )

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[(pdf.n1 > 0) & (pdf.n0 > 0) & (pdf.n1 + pdf.n0 > 2)].copy()
        dof = (d.n1 + d.n0 - 2).to_numpy(float)
        s2 = ((d.n1 - 1) * d.v1 + (d.n0 - 1) * d.v0).to_numpy(float) / dof
        ok = s2 > 0
        prior_df, prior = 0.0, 0.0
        if ok.sum() > 1:
            z, half = np.log(s2[ok]), dof[ok] / 2
            e = z - _digamma(half) + np.log(half)
            spread = e.var(ddof=1) - _trigamma(half).mean()
            if spread > 0:
                prior_df = 2 * _inverse_trigamma(spread)
                prior = float(np.exp(e.mean() + _digamma(prior_df / 2) - np.log(prior_df / 2)))
            else:
                prior_df, prior = np.inf, float(np.exp(e.mean()))
        post = np.full(len(s2), prior) if np.isinf(prior_df) else (prior_df * prior + dof * s2) / (prior_df + dof)
        diff = (d.m1 - d.m0).to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = diff / np.sqrt(post * (1 / d.n1 + 1 / d.n0).to_numpy(float))
        total = np.minimum(prior_df + dof, dof.sum())
        out = d[[*keys, gene]].copy()
        out["log_fc"], out["t"], out["df"], out["p"], out["s2_post"] = diff, t, total, t_two_sided(t, total), post
        return out

    return stats.groupBy(*keys).applyInPandas(shrink, _schema(df, keys, gene, "log_fc double, t double, df double, p double, s2_post double"))
