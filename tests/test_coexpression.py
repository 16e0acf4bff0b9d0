"""Correlation tiles against pandas, one matrix a group."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pytest

from evistrata.operators import coexpression as C


def made(genes, samples, seed, gaps=0.1):
    """A matrix with gaps, factors that tie genes together, and a gene without spread."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(samples, 6))
    x = rng.normal(size=(samples, genes))
    for g in range(genes):
        if g % 5 == 0:
            x[:, g] += (1.5 if g % 2 else -1.5) * factors[:, g % 6]
    x[rng.random(x.shape) < gaps] = np.nan
    x[:, 3] = 7.25
    return pd.DataFrame(x, index=[f"s{i:04}" for i in range(samples)], columns=[f"g{i:04}" for i in range(genes)])


def long(spark, frames):
    rows = [pd.DataFrame({"grp": k, "gene": f.columns[j], "sample": f.index, "value": f.iloc[:, j].to_numpy()}) for k, f in frames.items() for j in range(f.shape[1])]
    return spark.createDataFrame(pd.concat(rows, ignore_index=True))


def brute_r(f, least):
    return f.corr(method="pearson", min_periods=least).to_numpy()


def brute_null(f, least, quantile, perms, seed):
    values = []
    for t in range(perms):
        y = f.copy()
        for name in y.columns:
            x = y[name].to_numpy().copy()
            there = np.flatnonzero(~np.isnan(x))
            x[there] = np.random.default_rng([seed, t, zlib.crc32(name.encode())]).permutation(x[there])
            y[name] = x
        r = np.abs(brute_r(y, least))[np.triu_indices(f.shape[1], 1)]
        values.append(r[np.isfinite(r)])
    return float(np.quantile(np.concatenate(values), quantile))


def brute_stable(f, limit, least, reps, stable, sign, seed):
    rng, found = np.random.default_rng(seed), {}
    for _ in range(reps):
        again = f.iloc[rng.integers(0, len(f), size=len(f))]
        r, have = brute_r(again, least), (~again.isna()).to_numpy().astype(int)
        n = have.T @ have
        for i, j in zip(*np.nonzero(np.triu(np.isfinite(r) & (np.abs(r) >= limit), 1))):
            found.setdefault((f.columns[i], f.columns[j]), []).append((r[i, j], n[i, j]))
    out = {}
    for pair, rs in found.items():
        r, n = np.array([x[0] for x in rs]), np.array([x[1] for x in rs])
        agree = max((r > 0).sum(), (r <= 0).sum()) / len(r)
        if len(r) >= np.ceil(stable * reps) and agree >= sign:
            out[pair] = (len(r), agree, float(np.median(r)), float(np.median(np.abs(r))), int(np.median(n)))
    return out


def test_pairs_equal_pandas(spark):
    frames = {"a": made(70, 60, 1), "b": made(40, 35, 2, 0.3)}
    got = C.pair_correlations(long(spark, frames), ["grp"], least_pairs=20, tile_genes=16).toPandas()
    for k, f in frames.items():
        r = brute_r(f, 20)
        have = (~f.isna()).to_numpy().astype(int)
        want = {(f.columns[i], f.columns[j]): (r[i, j], (have.T @ have)[i, j]) for i, j in zip(*np.nonzero(np.triu(np.isfinite(r), 1)))}
        own = {(x.u, x.v): (x.r, x.n) for x in got[got.grp == k].itertuples()}
        assert set(own) == set(want)
        assert all(abs(own[p][0] - want[p][0]) < 1e-9 and own[p][1] == want[p][1] for p in want)


@pytest.mark.parametrize(("genes", "samples", "tile"), [(300, 80, 64), (30, 50, 7)])
def test_stable_edges_equal_pandas(spark, genes, samples, tile):
    frames = {"a": made(genes, samples, 3), "b": made(25, 40, 4), "few": made(4, 40, 5)}
    df = long(spark, frames)
    got = C.coexpression(df, ["grp"], reps=20, tile_genes=tile).toPandas()
    assert set(got.grp) <= {"a", "b"}
    for k in ("a", "b"):
        limit = brute_null(frames[k], 20, 0.995, 2, 123)
        want = brute_stable(frames[k], limit, 20, 20, 0.6, 0.9, 123)
        own = got[got.grp == k]
        assert abs(own.threshold.iloc[0] - limit) < 1e-9 and want
        assert {(x.u, x.v): x.selected for x in own.itertuples()} == {p: w[0] for p, w in want.items()}
        for x in own.itertuples():
            assert np.allclose((x.sign_consistency, x.median_r, x.median_abs_r, x.median_n), want[x.u, x.v][1:])
    parts = df.groupBy("grp").count().count()
    assert parts == 3


def test_shared_predictors_rule_edges_out(spark):
    df = long(spark, {"a": made(30, 60, 6)})
    edges = C.coexpression(df, ["grp"], reps=10).collect()
    first, second = edges[0], edges[1]
    predictors = spark.createDataFrame([(first.u, "x"), (first.v, "x"), (first.u, "y"), (second.u, "z"), (second.v, "q")], "gene string, snp string")
    left = {(r.u, r.v) for r in C.coexpression(df, ["grp"], reps=10, predictors=predictors).collect()}
    assert left == {(r.u, r.v) for r in edges} - {(first.u, first.v)}


def test_awkward_values(spark):
    rows = [("g1", 1, 1.0), ("g1", 1, 0.5), ("g1", 2, None), ("g1", 3, float("nan")), ("g1", 4, 4.0), ("g1", 5, 2.0), ("g2", 1, 0.5), ("g2", 4, 4.0), ("g2", 5, 2.0), ("g2", 3, 9.0), ("g3", 9, 1.0)]
    df = spark.createDataFrame(rows, "gene string, sample int, value double")
    assert [tuple(r) for r in C.pair_correlations(df, [], least_pairs=3).collect()] == [("g1", "g2", pytest.approx(1.0), 3)]
    assert C.pair_correlations(df.limit(0), []).count() == 0
    assert C.coexpression(df, [], least_pairs=3).count() == 0
    assert C.coexpression(df.limit(0).selectExpr("*", "'a' AS grp"), ["grp"]).count() == 0


def test_no_task_holds_a_group(spark):
    tiles = C._in_tiles(spark.createDataFrame([(f"g{i}", [1], [1.0]) for i in range(200)], "gene string, __at array<int>, __value array<double>"), [], "gene", 20)
    per = tiles.groupBy("__i", "__j").count().collect()
    assert len(per) == 55 and max(r["count"] for r in per) < 80
    assert {(r["__i"], r["__j"]) for r in per} == {(i, j) for i in range(10) for j in range(i, 10)}
    assert re.fullmatch(r"\d+", str(C.TILE_GENES))
