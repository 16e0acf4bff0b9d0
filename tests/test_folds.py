"""Running summaries: several runs, a repeated batch and compaction against one pass over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.streaming import folds

SCHEMA = "gene string, fold string, tissue int, effect double"
STATE = dict(keys=["gene"], value="effect", sets=["fold"], numbers=["tissue"])


def rows(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", None, f"only{seed}"]), rng.choice("uvw"), rng.randint(1, 32768), rng.choice([None, float("nan"), 1e8 + rng.random(), 1e8 - rng.random()])) for _ in range(n)]


def plain(all_rows):
    out = {}
    for gene in {r[0] for r in all_rows}:
        own = [r for r in all_rows if r[0] == gene]
        x = np.array([r[3] for r in own if r[3] is not None and r[3] == r[3]])
        out[gene] = (len(x), x.mean(), x.std(ddof=1), x.min(), x.max(), sorted({r[1] for r in own}), len({r[2] for r in own}))
    return out


def check(got, want):
    assert set(got) == set(want)
    for gene, w in want.items():
        g = got[gene]
        assert (g.n, g.low, g.high, g.fold, g.n_fold, g.n_tissue) == (w[0], w[3], w[4], w[5], len(w[5]), w[6])
        assert g["mean"] == pytest.approx(w[1], rel=1e-14) and g["std"] == pytest.approx(w[2], rel=1e-7)


def read(spark, target):
    return {r.gene: r for r in folds.summary(folds.state(spark, target, ["gene"]), ["gene"]).collect()}


def test_runs_equal_one_pass(spark, tmp_path):
    source, target, at = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/at"
    for run in range(3):
        spark.createDataFrame(rows(run), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        folds.ingest_summaries(spark, source, SCHEMA, target, at, **STATE).awaitTermination()
        check(read(spark, target), plain([r for k in range(run + 1) for r in rows(k)]))
    folds.ingest_summaries(spark, source, SCHEMA, target, at, **STATE).awaitTermination()  # nothing new
    folds.fold_in(spark.createDataFrame(rows(2), SCHEMA), 2, target, **STATE)  # the last batch once more
    want = plain([r for k in range(3) for r in rows(k)])
    check(read(spark, target), want)
    assert folds.compact(spark, target, ["gene"]) == 2
    check(read(spark, target), want)
    folds.fold_in(spark.createDataFrame(rows(7), SCHEMA), 3, target, **STATE)
    check(read(spark, target), plain([r for k in (0, 1, 2, 7) for r in rows(k)]))


def test_keys_without_values_and_wrong_numbers(spark, tmp_path):
    target = f"{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        folds.state(spark, target, ["gene"])
    folds.fold_in(spark.createDataFrame([("a", "u", None, None)], SCHEMA), 0, target, **STATE)
    folds.fold_in(spark.createDataFrame([("b", None, 5, 2.0)], SCHEMA), 1, target, **STATE)
    got = read(spark, target)
    assert (got["a"].n, got["a"]["mean"], got["a"].fold, got["a"].n_tissue) == (0, None, ["u"], 0)
    assert (got["b"].n, got["b"]["mean"], got["b"]["std"], got["b"].fold, got["b"].n_tissue) == (1, 2.0, None, [], 1)
    with pytest.raises(Exception, match="tissue is not within"):
        folds.partial(spark.createDataFrame([("a", "u", 40000, 1.0)], SCHEMA), **STATE).collect()


def test_merge_of_parts_equals_the_whole(spark):
    df = spark.createDataFrame(rows(9, 900), SCHEMA).withColumn("part", F.pmod(F.xxhash64("tissue", "effect"), F.lit(7)))
    parts = [folds.partial(df.filter(F.col("part") == k), **STATE) for k in range(7)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    check({r.gene: r for r in folds.summary(folds.merged(every, ["gene"]), ["gene"]).collect()}, plain(rows(9, 900)))
