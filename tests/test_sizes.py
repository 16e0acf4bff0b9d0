"""What is shuffled or held grows no faster than the rows: plans and states of queries that were too large."""

from __future__ import annotations

import math
import re
import time

import pytest
from pyspark.sql import functions as F

from evistrata.functions import pvalues as P
from evistrata.operators import permutation as M
from evistrata.operators import written
from evistrata.operators.ranking import placed, ranked
from evistrata.operators.rollups import fold_drugs
from evistrata.operators.statistics import over_representation
from evistrata.plans import q_more, q_scoring
from evistrata.streaming import folds


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_large_groups_are_no_window_a_group(spark, sf_dir):
    rows = spark.createDataFrame([(i % 3, i * 7 % 50, i) for i in range(200)], "fold int, n int, gene int")
    order = [F.desc("n"), F.asc("gene")]
    assert sorted(placed(rows, order, ["fold"]).collect()) == sorted(ranked(rows, order, ["fold"]).collect())
    genes = rows.selectExpr("fold", "gene", "n AS weight", "1 AS rank")
    drugs = rows.selectExpr("gene", "gene % 5 AS drug")
    assert "Expand" not in plan(fold_drugs(genes, drugs, "fold", "gene", "rank", "weight", "drug"))
    assert "row_number" not in plan(q_more.j17_fold_drugs(spark, sf_dir))


def test_pathway_terms_are_counted_after_their_genes(spark, sf_dir):
    assert "collect_set" not in plan(q_scoring.paths(spark, sf_dir))


def test_states_hold_bitmaps_up_to_the_largest_number(spark):
    rows = spark.createDataFrame([("a", 1.0, 7), ("a", 2.0, 8), ("b", 3.0, 20_000), ("c", None, None)], "gene string, effect double, tissue int")
    states = folds.partial(rows, ["gene"], "effect", [], ["tissue"])
    assert {r.gene: len(r.bits_tissue) for r in states.collect()} == {"a": 1, "b": 2_500, "c": 0}
    assert {r.gene: r.n_tissue for r in folds.summary(folds.merged(states.unionByName(states), ["gene"]), ["gene"]).collect()} == {"a": 2, "b": 1, "c": 0}


@pytest.mark.parametrize("spare", [100, -11])
def test_resamples_keep_the_first_items(spark, monkeypatch, spare):
    """Twelve items and a bound of one (a spare of -11 to twice six), below which replicates are short and keep all draws."""
    import hashlib

    monkeypatch.setattr(M, "SPARE", spare)
    n, reps, k = 12, 6, 6
    got = M.bootstrap_stability(spark.createDataFrame([(i, float(i % 5)) for i in range(n)], "gene int, score double"), [k], reps, 42).first()
    tops = []
    for rep in range(1, reps + 1):
        drawn = [int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:12], 16) % n for i in range(n)]
        tops.append(set(sorted(drawn, key=lambda i: (-(i % 5), i))[:k]))
    pairs = [(a, b) for i, a in enumerate(tops) for b in tops[i + 1 :]]
    assert got.union_size == len(set.union(*tops)) and got.in_every_group == len(set.intersection(*tops))
    assert got.mean_jaccard == pytest.approx(sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs))


def test_over_representation_has_parts_in_proportion_to_its_rows(spark, monkeypatch):
    """However few parts a shuffle has by default, a task holds about as many rows at every size; rows stay the same."""
    monkeypatch.setattr(written, "PART_ROWS", 100)
    terms = spark.range(1_000).selectExpr("id % 40 AS term", "id * 7 % 300 AS gene")
    sets, universe = terms.selectExpr("gene % 3 AS fold", "gene").filter("gene % 2 = 0"), terms.select("gene")
    assert "REPARTITION_BY_NUM" in (text := plan(found := over_representation(sets, terms, universe, "fold", "term", "gene", least=2)))
    assert re.search(r"hashpartitioning\(gene#\d+L, 10\)", text) and "hashpartitioning(gene#" not in re.sub(r"hashpartitioning\(gene#\d+L, 10\)", "", text)
    t, s, u = ({tuple(r) for r in x.collect()} for x in (terms, sets, universe))
    for r in (rows := found.collect()):
        genes, own = {g for k, g in t if k == r.term}, {g for f, g in s if f == r.fold}
        assert (r.overlap, r.term_size, r.set_size, r.universe) == (len(genes & own), len(genes), len(own), len(u))
    assert len(rows) == sum(len({g for k, g in t if k == x} & {g for f, g in s if f == y}) >= 2 for x in range(40) for y in range(3))


def test_tails_cost_some_terms_a_row_and_are_exact():
    """100,000 rows of large sets in a few seconds; before, each summed all terms up to the smaller size."""
    cases = [(k, m, s, d) for m, s, d in ((50, 10, 20), (30, 25, 20), (400, 60, 350), (9, 0, 4), (9, 9, 9)) for k in range(-1, min(s, d) + 3)]
    for upper in (True, False):
        found = P.hypergeometric_tails(*zip(*cases), [upper] * len(cases))
        for p, (k, m, s, d) in zip(found, cases):
            i = range(max(0, k, d + s - m), min(s, d) + 1) if upper else range(max(0, d + s - m), min(k, s, d) + 1)
            assert p == pytest.approx(sum(math.comb(s, x) * math.comb(m - s, d - x) for x in i) / math.comb(m, d), rel=1e-9, abs=1e-12)
    assert P.hypergeometric_tails([1, 70_000], [10**6] * 2, [90_000] * 2, [500_000] * 2, [True] * 2).tolist() == [1.0, 0.0]
    began, k = time.process_time(), [20 + n % 30 for n in range(100_000)]
    P.hypergeometric_tails(k, [1_200_000] * len(k), [50_000] * len(k), [600] * len(k), [True] * len(k))
    assert time.process_time() - began < 20
