"""Kernels on closed forms, invariants, and awkward rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.functions import numeric as N
from evistrata.functions import pvalues as P
from evistrata.functions import text as X
from evistrata.operators import causal as C
from evistrata.operators import graph as G
from evistrata.operators import kernels as K
from evistrata.operators import ranking as R
from evistrata.operators import scoring as S
from evistrata.operators import sets as U
from evistrata.operators import statistics as ST
from evistrata.operators import tables as T


def test_hypergeometric_is_exact():
    for m, s, d, k in [(50, 10, 5, 2), (20, 20, 3, 3), (30, 4, 28, 4), (100, 30, 40, 0)]:
        exact = sum(math.comb(s, i) * math.comb(m - s, d - i) for i in range(k, min(s, d) + 1) if d - i <= m - s) / math.comb(m, d)
        assert P.hypergeometric(k, m, s, d) == pytest.approx(exact, rel=1e-9)
    assert P.hypergeometric(1, 50, 10, 20, upper=False) == pytest.approx(sum(math.comb(10, i) * math.comb(40, 20 - i) for i in (0, 1)) / math.comb(50, 20))


def test_tails():
    assert P.normal_two_sided(np.array([0.0, 1.959963985]))[1] == pytest.approx(0.05, abs=1e-8)
    # t with 1 degree of freedom is Cauchy, with 2 it has a closed form.
    t = np.array([0.5, 1.0, 12.7])
    assert P.t_two_sided(t, np.ones(3)) == pytest.approx(1 - 2 * np.arctan(t) / math.pi)
    assert P.t_two_sided(t, np.full(3, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t))
    assert P.f_upper(np.array([4.0]), np.array([1.0]), np.array([10.0])) == pytest.approx(P.t_two_sided(np.array([2.0]), np.array([10.0])))


def test_bh_by_hand(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,), (0.5,), (0.04,)], "p double")
    got = {(r.p, round(r.q, 9)) if r.p is not None else (None, r.q) for r in R.benjamini_hochberg(p, "p").collect()}
    assert got == {(0.01, 0.05), (0.03, 0.05), (0.04, 0.05), (0.5, 0.5), (None, None)}


def test_auc_invariants(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9) / 10, rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "s double, y int")
    a = R.auc_scores(df, "s", "y").first()
    b = R.auc_scores(df.withColumn("s", -F.col("s")), "s", "y").first()
    pairs = [(0.5 if x == z else float(x > z)) for x, y in rows if y for z, w in rows if not w]
    assert a.roc_auc == pytest.approx(sum(pairs) / len(pairs)) and a.roc_auc + b.roc_auc == pytest.approx(1)
    one = R.auc_scores(df.withColumn("y", F.lit(1)), "s", "y").first()
    assert one.roc_auc is None and one.average_precision == 1


def test_percentile_rank_zeroes(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (-2.0,), (None,), (3.0,)], "x double")
    assert sorted(r[0] for r in R.percentile_rank(df, "x", "x").select("x").collect()) == [0.0, 0.0, 0.625, 0.625, 1.0]


def test_jaccard_of_empty_sets(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), ("b", 2)], "g string, i int")
    groups = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "g string")
    for empty in (0.0, 1.0, None):
        got = {(r.a, r.b): r.jaccard for r in U.pairwise_jaccard(sets, "g", "i", empty, groups).collect()}
        assert got[("a", "b")] == 0.5 and got[("a", "c")] == 0 and got[("c", "d")] == empty


def test_names(spark):
    names = ["Aspirin (oral) 50 mg HCl", "A & B/C", None, "nan", "  ", "[x] Sodium"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.drug_key(F.col("n"))).collect()]
    assert got == ["aspirin", "a and b c", "", "", "", ""]
    one = spark.range(1)
    assert one.select(X.drug_key(F.lit("x Sodium"), salts=False)).first()[0] == "x sodium"
    assert one.select(X.phase_label(F.lit("phase 3")), X.phase_label(F.lit(None).cast("string")), X.phase_weight(F.lit("2"), F.lit(True))).first()[0:3] == ("PHASE3", "", 5.0)
    assert one.select(X.gene_list(F.lit("b, a;A|b"))).first()[0] == ["B", "A"]
    assert one.select(X.chromosome_number(F.lit("chrX")), X.chromosome_number(F.lit("chr7"))).first()[0:2] == (None, 7)


def test_consistency_label(spark):
    rows = spark.createDataFrame([(None,), (0.6,), (0.4,), (0.5,)], "x double")
    assert [r[0] for r in rows.select(N.consistency_label(F.col("x"))).collect()] == ["Unknown", "Consistent", "Opposite", "Mixed"]


def grouped(spark, n=40, genes=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        for g in range(genes):
            rows.append(("k", f"g{g}", s, int(s % 2), float(rng.normal() + (0.8 * (s % 2) if g == 0 else 0) if g < genes - 1 else 1.0)))
    return spark.createDataFrame(rows, "grp string, gene string, sample int, status int, value double")


def test_welch_and_rank_sum_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 4.0), ("a", 0, 0.0), ("a", 0, 1.0), ("b", 1, None), ("b", 0, 3.0)], "gene string, status int, value double")
    w = {r.gene: r for r in ST.welch(df, ["gene"], "value", "status").collect()}
    v1, v0 = np.var([1, 2, 4], ddof=1) / 3, np.var([0, 1], ddof=1) / 2
    assert w["a"].t == pytest.approx((7 / 3 - 0.5) / math.sqrt(v1 + v0)) and w["b"].t is None
    u = {r.gene: r for r in ST.rank_sum(df, ["gene"], "value", "status").collect()}["a"]
    assert u.u == 5.5  # pairs: five greater, one tie


def test_logistic_fits_solve_their_equations(spark):
    rows = grouped(spark).filter("gene = 'g0'").toPandas().sort_values("sample")
    x, y = rows.value.to_numpy()[:, None], rows.status.to_numpy(float)
    for kind in ("weighted", "firth", "bayes"):
        b, se, done = K.logistic_fits(x, y, kind, 200)
        assert done.all() and se[0] > 0 and b[0] > 0
    got = {r.gene: r for r in K.logistic(grouped(spark), ["grp"], "firth").collect()}
    assert "g4" not in got and got["g0"].log_or == pytest.approx(K.logistic_fits(x, y, "firth", 100)[0][0], rel=1e-6)
    # Separated classes have a finite estimate under the penalty.
    sep = np.concatenate([np.zeros(5), np.ones(5)])
    assert np.isfinite(K.logistic_fits(sep[:, None], sep, "firth", 100)[0]).all()


def test_permutation_and_moderated(spark):
    p = {r.gene: r.p for r in K.permutation_test(grouped(spark), ["grp"], reps=200).collect()}
    assert p["g4"] == 1.0 and all(1 / 201 <= v <= 1 for v in p.values())
    assert p == {r.gene: r.p for r in K.permutation_test(grouped(spark), ["grp"], reps=200).collect()}
    m = {r.gene: r for r in K.moderated_t(grouped(spark, genes=8), ["grp"]).collect()}
    w = {r.gene: r for r in ST.welch(grouped(spark, genes=8), ["gene"], "value", "status").collect()}
    assert m["g0"].log_fc == pytest.approx(w["g0"].mean_difference) and abs(m["g0"].t - w["g0"].t) < 1


def test_residuals_are_orthogonal(spark):
    df = grouped(spark).withColumn("value", F.when((F.col("sample") == 3) & (F.col("gene") == "g1"), None).otherwise(F.col("value")))
    cov = df.select("sample", (F.col("sample") % 3).cast("double").alias("c")).distinct()
    out = K.residualised(df, cov, ["grp"], ["c"], add_mean=False).toPandas()
    full = out[out.gene == "g0"]
    assert abs((full.value * (full["sample"] % 3)).sum()) < 1e-8 and abs(full.value.sum()) < 1e-8
    assert out[(out.gene == "g1") & (out["sample"] == 3)].value.isna().all()


def test_components_and_centrality(spark):
    e = spark.createDataFrame([("p", "q", 1.0), ("q", "r", 2.0), ("x", "y", 1.0), ("z", "z", 1.0), ("q", "p", 3.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "pqrxyz"], "node string")
    g = G.induced(e, nodes)
    assert {(r.u, r.v): r.w for r in g.collect()} == {("p", "q"): 3.0, ("q", "r"): 2.0, ("x", "y"): 1.0}
    assert {r.node: r.component for r in G.connected_components(e).collect()} == {"p": "p", "q": "p", "r": "p", "x": "x", "y": "x"}
    s = {r.node: (r.degree, r.strength) for r in G.strengths(g, nodes).collect()}
    assert s["q"] == (2, 5.0) and s["z"] == (0, 0.0)
    rank = {r.node: r.pagerank for r in G.pagerank(g, nodes, 30).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["q"] == max(rank.values())
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    assert Counter(r.component for r in G.connected_components(chain).collect()) == {0: 61, 100: 2}


def test_alignment_and_ratio(spark):
    eqtl = spark.createDataFrame([(1, 5, "A", "C", 0.5, 0.1), (1, 6, "A", "C", 0.5, 0.1), (1, 7, "A", "C", 0.0, 0.1)], "chr int, pos int, ref string, alt string, eqtl_beta double, eqtl_se double")
    gwas = spark.createDataFrame([(1, 5, "A", "C", 0.2, 0.05), (1, 6, "C", "A", 0.2, 0.05), (1, 7, "A", "C", 0.2, 0.05), (1, 5, "G", "T", 9.0, 1.0)], "chr int, pos int, a1 string, a2 string, gwas_beta double, gwas_se double")
    h = {r.pos: r for r in C.wald_ratio(C.harmonised(eqtl, gwas)).collect()}
    assert h[5].mr_beta == pytest.approx(0.4) and h[6].mr_beta == pytest.approx(-0.4) and h[7].mr_beta is None
    assert {r.pos: r.eqtl_beta_aligned for r in C.harmonised(eqtl, gwas, False).collect()}[5] == -0.5


def test_colocalisation_prefers_the_shared_signal(spark):
    rows = [("s", 0.5 if i == 3 else 0.01, 0.05, 0.4 if i == 3 else 0.01, 0.05) for i in range(30)] + [("d", 0.5 if i == 3 else 0.01, 0.05, 0.4 if i == 9 else 0.01, 0.05) for i in range(30)]
    got = {r.l: r for r in C.colocalised(spark.createDataFrame(rows, "l string, beta_1 double, se_1 double, beta_2 double, se_2 double"), ["l"]).collect()}
    assert got["s"].pp_h4 > 0.9 and got["d"].pp_h3 > 0.9
    assert all(sum(r[f"pp_h{i}"] for i in range(5)) == pytest.approx(1) for r in got.values())


@pytest.mark.parametrize("bin_points", [1_000_000, 5])
def test_range_join_equals_all_pairs(spark, bin_points, monkeypatch):
    monkeypatch.setattr(T, "BIN_POINTS", bin_points)
    rng = random.Random(4)
    pts = [(i, rng.choice("xyz"), rng.choice([rng.uniform(-50, 50), 10 ** rng.uniform(0, 8), 7.0])) for i in range(150)] + [(900, "x", None), (901, None, 1.0), (902, "x", float("nan"))]
    rgs = [(i, rng.choice("xy"), a := rng.choice([rng.uniform(-50, 50), 7.0]), a + rng.choice([-1, 0, 1, 3, 40, 10 ** rng.uniform(0, 8), 1e8])) for i in range(60)] + [(90, "x", None, 1.0), (91, "x", 0.0, None)]
    p, r = spark.createDataFrame(pts, "p int, c string, at double"), spark.createDataFrame(rgs, "r int, c string, low double, high double")
    inside = lambda x, a, b: None not in (x, a, b) and a <= x <= b
    got = T.range_join(p, r, "at", "low", "high", 7.0, ["c"])
    assert sorted((x.p, x.r) for x in got.collect()) == sorted((i, j) for i, c, x in pts for j, d, a, b in rgs if c == d and inside(x, a, b))
    assert set(got.columns) == {"p", "c", "at", "r", "low", "high"}
    free = T.range_join(p.drop("c"), r.drop("c"), "at", "low", "high", 1.0).collect()
    assert sorted((x.p, x.r) for x in free) == sorted((i, j) for i, _, x in pts for j, _, a, b in rgs if inside(x, a, b))
    assert T.range_join(p, r.limit(0), "at", "low", "high", 7.0, ["c"]).count() == 0


def test_long_ranges_stand_in_two_bins(spark):
    """A chromosome-long range beside short ones: the rows that are joined stay near the rows given."""
    r = spark.createDataFrame([(0, 0.0, 1e8), (1, 5.0, 6.0), (2, 100.0, 1000.0)], "r int, low double, high double")
    plan = T.range_join(spark.range(1000).select(F.col("id").cast("double").alias("at")), r, "at", "low", "high", 1.0)
    assert plan.count() == 1000 + 2 + 900
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" in text and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_small_groups_go(spark):
    rows = [("a", s, g) for s in range(10) for g in range(5)] + [("few samples", s, g) for s in range(9) for g in range(5)] + [("few genes", s, 0) for s in range(20)]
    rows += [(None, s, g) for s in range(10) for g in range(5)] + [("nulls", None, g) for g in range(50)] + [("twice", s % 9, s % 5) for s in range(500)]
    got = T.sufficient(spark.createDataFrame(rows, "k string, sample int, gene int"), ["k"])
    assert Counter(r.k for r in got.collect()) == {"a": 50, None: 50}


def test_halves_go_to_even(spark):
    xs = [0.125, 0.375, 2.675, -0.125, 1e-9, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(N.half_even(F.col("x"), 2)).collect()]
    assert got[:5] == [float(v) for v in np.round(xs[:5], 2)] and got[5] != got[5] and got[6] is None


def test_phenotype_codes(spark):
    for codes, want in (([1, 2, 2], [0, 1, 1]), ([0, 1, 1], [0, 1, 1]), ([3, 7, 9], [0, 0, 1])):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, pheno int")
        assert [r.status for r in T.phenotype_coded(df).orderBy("i").collect()] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "gene string, score double, positive int, fold int, rank long")
    assert tuple(R.auc_scores(none, "score", "positive").first()[:2]) == (None, None)
    assert R.auc_scores(none, "score", "positive", ["fold"]).count() == 0
    assert R.benjamini_hochberg(none, "score").count() == 0
    assert U.stability_at_k(none, "fold", "gene", "rank", [5]).count() == 0
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shuffles_keep_the_values(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "k int, v double")
    out = S.shuffled(df, "v", "k", 3, 7).toPandas()
    for _, part in out.groupby("rep"):
        assert sorted(part.v) == [float(i * i) for i in range(20)] and sorted(part.k) == list(range(20))
    assert out[out.rep == 1].sort_values("k").v.tolist() != out[out.rep == 2].sort_values("k").v.tolist()


def test_empirical_agrees_with_exact(spark):
    df = spark.createDataFrame([("a", 6, 100, 20, 20), ("b", 3, 100, 20, 20)], "u string, k long, m long, s long, d long")
    args = [F.col(c) for c in ("k", "m", "s", "d")]
    for r in df.select(P.hypergeometric_p(*args).alias("x"), P.empirical_hypergeometric_p(F.col("u"), *args).alias("e")).collect():
        assert abs(r.x - r.e) < 0.02


def test_edges_with_shared_predictors_go(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("c", "d", 0.7)], "u string, v string, w double")
    snps = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s3"), ("c", "s1"), ("c", "s4"), ("c", "s5"), ("c", "s5"), ("c", "s6"), ("c", "s7")], "gene string, snp string")
    assert sorted((r.u, r.v) for r in G.without_shared_predictors(edges, snps).collect()) == [("a", "c"), ("c", "d")]


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    from evistrata.operators import ml

    rows = [(float(i % 2), float(i % 2) + (i % 5) / 10, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, x double, y double")
    ready = ml.prepared(df, ["x", "y"], 2)
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01).fit(ready.transform(df))
    ml.save(ready, model, str(tmp_path / "m"))
    again = ml.load(str(tmp_path / "m"))
    want = [r.prediction for r in model.transform(ready.transform(df)).select("prediction").collect()]
    assert [r.prediction for r in again.transform(df).select("prediction").collect()] == want
    assert ml.importances(again.stages[-1], ["x", "y"])[0][0] == "x"


def test_variance_at_the_limit_counts_in_any_order(spark):
    """Tenths with a sample variance of 0.15 exactly: (n * sum of squares - square of the sum) / (n * (n - 1)) is 15."""
    rng = random.Random(3)
    sets = [k for k in ([rng.randint(-9, 9) for _ in range(11)] for _ in range(200_000)) if 11 * sum(x * x for x in k) - sum(k) ** 2 == 15 * 110][:40]
    rows = [(i, x / 10) for i, k in enumerate(sets) for x in k] + [(-1, x / 10) for x in [*sets[0][:-1], sets[0][-1] / 2]]
    got = T.varying(spark.createDataFrame(rows, "g int, x double").coalesce(1), "g", "x", least=0.15)
    assert len(sets) == 40 and {r.g for r in got.collect()} - {-1} == set(range(40))
    assert T.varying(spark.createDataFrame([(0, 0.1)] * 5, "g int, x double"), "g", "x").count() == 0


def test_range_summary_equals_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))])) for i in range(200)] + [(900, None), (901, float("nan"))]
    rgs = [(i % 50, a := rng.choice([rng.uniform(-60, 60), float(rng.randint(-5, 5))]), a + rng.choice([-1, 0, 1, 3, 40, 1e8])) for i in range(80)] + [(90, None, 1.0), (91, 0.0, None), (92, 0.0, float("nan"))]
    p, r = spark.createDataFrame(pts, "p int, at double"), spark.createDataFrame(rgs, "r int, low double, high double")
    want = {}
    for k, a, b in rgs:
        for i, x in pts:
            if None not in (x, a, b) and a <= x <= b:
                want.setdefault(k, []).append(i)
    got = T.range_summary(p, r, "at", "low", "high", "r", "p")
    assert {x.r: (x.n, x.first) for x in got.collect()} == {k: (len(v), min(v)) for k, v in want.items()}
    assert T.range_summary(p, r.limit(0), "at", "low", "high", "r", "p").count() == 0 and T.range_summary(p.limit(0), r, "at", "low", "high", "r", "p").count() == 0


def test_blocks_have_few_rows_and_labels_are_dealt_in_parts(spark, monkeypatch):
    """Results do not depend on the blocks; a task gets the rows of few genes where these have many samples."""
    rng = random.Random(6)
    df = spark.createDataFrame([("a", g, s, s % 2, rng.gauss(0.1 * g * (s % 2), 1.0), "long text") for g in range(12) for s in range(60)], "grp string, gene int, sample int, status int, value double, more string")
    own = lambda: sorted(map(tuple, K.permutation_test(df, ["grp"], reps=50).collect()))
    whole = own()
    assert K._blocked(df, ["grp"], "gene", "value")._df.columns == ["grp", "gene", "value", "__block"]
    monkeypatch.setattr(K, "BLOCK_ROWS", 120)
    monkeypatch.setattr(K, "MASK_VALUES", 500)
    assert len({r[0] for r in K._blocked(df, ["grp"], "gene", "value").agg(F.count("*")).select("__block").collect()}) > 2
    assert [(g, k, p) for g, k, _, p in own()] == [(g, k, p) for g, k, _, p in whole]
