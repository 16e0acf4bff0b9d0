"""Running totals, ranks and percentiles of whole tables against pandas and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evistrata.operators import ordered as O
from evistrata.operators import permutation as M
from evistrata.operators import ranking as R
from evistrata.operators import rollups as A


def values(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.choice([None, *[round(rng.random(), 2) for _ in range(3)]])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_ranks_and_numbers(spark, n):
    rows = values(n)
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(5)
    got = O.numbered(df, [F.desc_nulls_last("x"), F.asc("i")], "place").toPandas().sort_values("place")
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got["i"].tolist() == [r[0] for r in want] and got["place"].tolist() == list(range(1, n + 1))
    ranks = O.with_average_rank(df, "x", "r").toPandas().sort_values("i")
    xs = pd.Series([r[2] for r in rows], dtype=float)
    np.testing.assert_allclose(ranks["r"].astype(float), xs.rank())
    assert set(ranks["r_n"]) <= {int(xs.notna().sum())}


@pytest.mark.parametrize("n", [0, 1, 2, 301])
def test_percentiles(spark, n):
    rows = values(n, 2)
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    pdf = pd.DataFrame(rows, columns=["i", "g", "x"]).dropna()
    got = O.exact_percentiles(df, "x", shares).collect()
    assert len(got) == int(len(pdf) > 0)
    for r in got:
        np.testing.assert_allclose(r.percentiles, np.quantile(pdf["x"].to_numpy(float), shares))
    by = {r.g: r.percentiles for r in O.exact_percentiles(df, "x", shares, ["g"]).collect()}
    assert set(by) == set(pdf["g"])
    for g, own in pdf.groupby("g"):
        np.testing.assert_allclose(by[g], np.quantile(own["x"].to_numpy(float), shares))


def plain_bh(ps):
    known = sorted(p for p in ps if p is not None)
    n, out, best = len(known), {}, 1.0
    for i in range(n - 1, -1, -1):
        place = max(k for k in range(n) if known[k] == known[i]) + 1
        best = min(best, known[i] * n / place)
        out[known[i]] = best
    return [None if p is None else out[p] for p in ps]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_corrected_p(spark, by):
    rows = values(200, 3)
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(6)
    got = {r.i: r.q for r in R.benjamini_hochberg(df, "x", by).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else 0, []).append(r)
    assert len(got) == len(rows)
    for own in groups.values():
        for r, q in zip(own, plain_bh([x for _, _, x in own])):
            assert got[r[0]] is None if q is None else abs(got[r[0]] - q) < 1e-12


def test_running_minimum_by_group(spark):
    rows = [(g, i, (i * 37) % 11) for g in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {(r.g, r.i): (r.low, r.total) for r in O.running(df, [F.asc("i")], {"low": ("min", F.col("v")), "total": ("sum", F.col("v"))}, ["g"]).collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j <= i]
        assert got[g, i] == (min(before), sum(before))


def test_merged_back_keeps_every_row(spark):
    base = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    results = spark.createDataFrame([(1, 5.0), (1, 3.0), (3, 1.0), (None, 2.0)], "k int, q double")
    got = sorted(((r.k or 0, r.q, r.has_result) for r in A.merged_back(base, results, ["k"], [F.asc("q")]).collect()), key=str)
    assert got == [(0, None, False), (1, 3.0, True), (1, 3.0, True), (2, None, False)]


def test_random_sets_fall_back_to_all_genes(spark):
    genes = spark.createDataFrame([(i,) for i in range(4)], "gene int")
    drugs = spark.createDataFrame([(0, "x"), (1, "y")], "gene int, drug string")
    ref = spark.createDataFrame([("x",)], "drug string")
    r = M.random_gene_sets(genes, genes, drugs, ref, reps=20).first()
    assert (r.observed_overlap, r.observed_drugs, r.null_mean, r.null_sd, r.z, r.p_overlap) == (1, 2, 1.0, 0.0, 0.0, 1.0)
    pairs = M.degree_bins(genes, drugs, 2).collect()
    assert {x.gene: x.bin for x in pairs} == {2: 0, 3: 0, 0: 1, 1: 1}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, float("nan")), (4, None)], "i int, x double")
    q = {r.i: r.q for r in R.benjamini_hochberg(df, "x").collect()}
    assert (q[1], q[2]) == (0.02, 0.02) and q[3] is None and q[4] is None
    share = {r.i: r.s for r in R.percentile_rank(df, "x", "s").collect()}
    assert share == {1: 0.5, 2: 1.0, 3: 0.0, 4: 0.0}
    assert {r.i: r.w for r in R.gene_weight(df, "x", "w").collect()} == {1: pytest.approx(1e-6), 2: pytest.approx(0.5 + 1e-6), 3: None, 4: None}
    assert O.exact_percentiles(df, "x", [1.0]).first().percentiles == [0.02]
    flags = df.withColumn("y", (F.col("i") % 2).cast("int"))
    assert tuple(R.auc_scores(flags, "x", "y").first()) == (0.0, 0.5, 1, 1)


def test_small_sets_are_refused(spark):
    genes = spark.createDataFrame([(i,) for i in range(30)], "gene int")
    drugs = spark.createDataFrame([(i, f"d{i % 7}") for i in range(25)], "gene int, drug string")
    with pytest.raises(ValueError, match="at least 20"):
        M.degree_matched(genes.filter("gene < 10"), genes, drugs, drugs.select("drug"), reps=5)
    r = M.degree_matched(genes, genes, drugs, drugs.filter("gene < 3").select("drug"), reps=5).first()
    assert (r.n_genes, r.observed_drugs, r.observed_overlap, r.observed_recall, r.p_overlap, r.z, r.fold) == (30, 7, 3, 1.0, 1.0, 0.0, 1.0)


def test_resampled_rankings_count_copies(spark):
    import hashlib

    scores = {f"k{i:02}": i % 5 for i in range(30)}
    names, tops = sorted(scores), []
    for rep in range(1, 9):
        drawn = [names[int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:12], 16) % 30] for i in range(30)]
        tops.append(set(sorted(drawn, key=lambda k: (-scores[k], k))[:10]))
    pairs = [(a, b) for i, a in enumerate(tops) for b in tops[i + 1 :]]
    want = sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs)
    got = M.bootstrap_stability(spark.createDataFrame(list(scores.items()), "gene string, score int"), [10], 8).first()
    assert got.mean_jaccard == pytest.approx(want) and got.union_size == len(set().union(*tops))


def test_names_fall_into_the_first_group(spark):
    df = spark.createDataFrame([("Brain Cortex",), ("LIVER",), ("blood",), (None,)], "x string")
    got = [r[0] for r in df.select(A.grouped_names(F.col("x"), {"Brain": ("brain", "cortex"), "Organ": ("liver", "cortex")})).collect()]
    assert got == ["Brain", "Organ", "Other", None]


@pytest.mark.parametrize("spare", [M.SPARE if hasattr(M, "SPARE") else 100, -35.0])
def test_draws_order_few_rows(spark, monkeypatch, spare):
    """The drawn keys are the first by md5, also where the bound lets too few through; few rows are put in order."""
    import hashlib

    monkeypatch.setattr(M, "SPARE", spare, raising=False)
    seen, whole = [], M.running
    monkeypatch.setattr(M, "running", lambda df, *rest: (seen.append(df.count()), whole(df, *rest))[1])
    universe = spark.range(3_000).select(F.col("id").alias("gene"), F.when(F.col("id") < 2_995, F.col("id") % 2).otherwise(2).alias("bin"))
    sizes = spark.createDataFrame([(0, 20), (1, 25), (2, 9)], "bin int, n long")
    md5 = lambda rep, g: hashlib.md5(f"7:{rep}:{g}".encode()).hexdigest()
    want = set()
    for rep in range(1, 11):
        for own, n in ((range(0, 2_995, 2), 20), (range(1, 2_995, 2), 25), (range(2_995, 3_000), 9)):
            want |= {(rep, g) for g in sorted(own, key=lambda g: md5(rep, g))[:n]}
    got = M._drawn(universe, sizes, "gene", ["bin"], 10, 7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert spare < 0 or seen[0] < 10 * 3 * (2 * 25 + 100)
    free = M._drawn(universe, spark.createDataFrame([(20,)], "n long"), "gene", [], 10, 7)
    assert {tuple(r) for r in free.collect()} == {(rep, g) for rep in range(1, 11) for g in sorted(range(3_000), key=lambda g: md5(rep, g))[:20]}
