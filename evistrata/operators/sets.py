"""Set operators on keyed tables: membership flags, overlaps, similarity, stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(key: str, **sets: DataFrame) -> DataFrame:
    """One row a key with a boolean column for each named set; null keys are dropped."""
    tagged = reduce(DataFrame.unionByName, (df.select(key).withColumn("__set", F.lit(name)) for name, df in sets.items()))
    flags = [(F.count_if(F.col("__set") == name) > 0).alias(name) for name in sets]
    return tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(*flags)


def overlap_table(flags: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Counts of three sets' single, pairwise, triple and exclusive regions, a row each."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    regions = {
        a: x, b: y, c: z, f"{a} & {b}": x & y, f"{a} & {c}": x & z, f"{b} & {c}": y & z,
        f"{a} & {b} & {c}": x & y & z, f"{a} | {b}": x | y, f"({a} | {b}) & {c}": (x | y) & z, f"{a} | {b} | {c}": x | y | z,
    }
    counts = flags.agg(*(F.count_if(cond).alias(name) for name, cond in regions.items()))
    return counts.unpivot([], list(counts.columns), "region", "n")


def regions(flags: DataFrame, names: list[str], score: Column | None = None) -> DataFrame:
    """Count (and mean score) of each exclusive region of the named flags."""
    extra = [] if score is None else [F.avg(score).alias("mean_score")]
    return flags.groupBy(*names).agg(F.count("*").alias("n"), *extra)


def concat(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def pairwise_jaccard(sets: DataFrame, group: str, item: str, empty: float | None = 0.0, groups: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of groups: both sizes, overlap, Jaccard, overlap fraction of the smaller.

    Only common items are joined, so disjoint pairs cost nothing; they come from the groups' own
    pairs, as do pairs of empty sets when ``groups`` names groups without items.
    """
    distinct = sets.select(group, item).filter(F.col(item).isNotNull()).distinct()
    named = distinct.select(group).distinct() if groups is None else groups.select(group).distinct()
    sizes = named.join(distinct.groupBy(group).agg(F.count("*").alias("n")), group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"))
    a, b = (sizes.select(F.col(group).alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    left, right = (distinct.select(F.col(group).alias(x), item) for x in ("a", "b"))
    shared = left.join(right, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union, small = F.col("n_a") + F.col("n_b") - F.col("shared"), F.least("n_a", "n_b")
    nothing = F.lit(empty).cast("double")
    return out.select("a", "b", "n_a", "n_b", "shared", F.when(union > 0, F.col("shared") / union).otherwise(nothing).alias("jaccard"), F.when(small > 0, F.col("shared") / small).otherwise(nothing).alias("overlap_fraction"))


def in_every(sets: DataFrame, group: str, item: str) -> DataFrame:
    """Items that all groups have, and how many groups there are."""
    n = sets.agg(F.count_distinct(group).alias("n_groups"))
    per = sets.groupBy(item).agg(F.count_distinct(group).alias("n"))
    return per.crossJoin(F.broadcast(n)).filter("n = n_groups").select(item, "n_groups")  # one row


def stability_at_k(ranks: DataFrame, group: str, item: str, rank: str, ks: list[int]) -> DataFrame:
    """Per k: groups, items in the union and in every group's first k, and the pairs' mean Jaccard and overlap."""
    from evistrata.operators.ranking import at_each_k

    top = at_each_k(ranks, ks, rank).select("k", group, item).distinct()
    groups = top.groupBy("k").agg(F.count_distinct(group).alias("n_groups"))
    per = top.groupBy("k", item).agg(F.count("*").alias("n"))
    whole = per.join(groups, "k").groupBy("k").agg(F.first("n_groups").alias("n_groups"), F.count("*").alias("union_size"), F.count_if(F.col("n") == F.col("n_groups")).alias("in_every_group"))
    sizes = top.groupBy("k", group).agg(F.count("*").alias("n"))
    a, b = (sizes.select("k", F.col(group).alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    left, right = (top.select("k", F.col(group).alias(x), item) for x in ("a", "b"))
    shared = left.join(right, ["k", item]).filter("a < b").groupBy("k", "a", "b").agg(F.count("*").alias("s"))
    pairs = a.join(b, "k").filter("a < b").join(shared, ["k", "a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    mean = pairs.groupBy("k").agg(F.avg(F.col("s") / (F.col("n_a") + F.col("n_b") - F.col("s"))).alias("mean_jaccard"), F.avg("s").alias("mean_overlap"))
    return whole.join(mean, "k", "left")


def recurrent(ranks: DataFrame, group: str, item: str, rank: str, k: int) -> DataFrame:
    """Items within a group's first k: in how many groups, with best and mean rank."""
    return ranks.filter(F.col(rank) <= k).groupBy(item).agg(F.count_distinct(group).alias("n_groups"), F.min(rank).alias("best_rank"), F.avg(rank).alias("mean_rank"))


def expand(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``more`` whose key ``base`` lacks, with those of ``base``, told apart by ``added``."""
    new = more.join(base.select(*key).distinct(), key, "left_anti").withColumn("added", F.lit(True))
    return base.withColumn("added", F.lit(False)).unionByName(new, allowMissingColumns=True)
