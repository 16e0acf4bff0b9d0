"""Ranks, percentiles, corrected p-values, top-K, bins and threshold-free evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.ordered import exact_percentiles, numbered, present, running, value_places, with_average_rank


def average_rank(x: str | Column, by: list[str], descending: bool = False) -> Column:
    """Rank from 1 within a group, ties get the mean of their places; null for null. For a whole table see ``ordered``."""
    c = F.col(x) if isinstance(x, str) else x
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    w = Window.partitionBy(*by)
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0)


def percentile_rank(df: DataFrame, x: str, name: str, zero: bool = True) -> DataFrame:
    """Add the average rank over the number of values; with ``zero`` missing and non-positive values get 0. NaN is missing."""
    r = with_average_rank(df, x, "__r")
    share = F.col("__r") / F.col("__r_n")
    return r.withColumn("__share", F.when((F.col(x) > 0) & F.col("__r").isNotNull(), share).otherwise(0.0) if zero else share).drop("__r", "__r_n", *([name] if name in df.columns else [])).withColumnRenamed("__share", name)


def percentile_ranks(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, cols): as ``percentile_rank`` with zeroing, all columns in one pass over (column, value); a key has one row."""
    long = df.select(key, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot([key], cols, "__column", "__x")
    places = value_places(long, "__x", ["__column"])
    n = places.groupBy(F.col("__column").alias("__n_column")).agg(F.sum("__count").alias("__n"))
    rank = ((F.col("__upto") - (F.col("__count") - 1) / 2.0) / F.col("__n")).alias("__rank")
    of_value = places.join(n, F.col("__column") == F.col("__n_column")).select(F.col("__column").alias("__p"), F.col("__x").alias("__v"), rank)
    share = F.when((F.col("__x") > 0) & F.col("__rank").isNotNull(), F.col("__rank")).otherwise(0.0)
    joined = long.join(of_value, (F.col("__column") == F.col("__p")) & (F.col("__x") == F.col("__v")), "left")
    return joined.groupBy(key).agg(*(F.max(F.when(F.col("__column") == c, share)).alias(c) for c in cols))


def gene_weight(df: DataFrame, score: str, name: str) -> DataFrame:
    """Add the rank weight of a score: the best has the largest, none is 0."""
    r = with_average_rank(df, score, "__r", descending=True)
    return r.withColumn(name, 1.0 - F.col("__r") / F.col("__r_n") + 1e-6).drop("__r", "__r_n")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] = (), name: str = "q") -> DataFrame:
    """Add BH q-values within each group: reverse running minimum of p * n / rank, at most 1; null and NaN p have none.

    Runs over the distinct p-values of each group, so neither a group nor the table is one task.
    """
    by = list(by)
    places = value_places(df, p, by)
    n = places.groupBy(*by).agg(F.sum("__count").alias("__n"))
    raw = F.col(p) * F.col("__n") / F.col("__upto")
    known = places.join(n, by) if by else places.crossJoin(F.broadcast(n))  # one row
    least = running(known.withColumn("__raw", raw), [F.desc(p)], {"__q": ("min", F.col("__raw"))}, by)
    found = least.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col(p).alias("__p"), F.least(F.lit(1.0), F.col("__q")).alias(name))
    match = F.col(p) == F.col("__p")
    for c in by:
        match &= F.col(c) == F.col(f"__k_{c}")
    return df.join(found, match, "left").drop("__p", *(f"__k_{c}" for c in by))


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a given order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def ranked(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "rank") -> DataFrame:
    """Add places from 1 in order, within each group or over the whole table."""
    if not by:
        return numbered(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def placed(df: DataFrame, order: list[Column], by: list[str], name: str = "rank") -> DataFrame:
    """As ``ranked``, within few groups of many rows: by ranges of the order, so a group is not one task."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))}, by)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, kept partial before they meet."""
    return df.orderBy(*order).limit(k)


def at_each_k(ranks: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """A copy of each row for every k that its rank is within."""
    return ranks.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col(rank))))


def quantile_edges(df: DataFrame, x: str, q: int) -> DataFrame:
    """One row: distinct edges of q equally filled bins; no row without values."""
    return exact_percentiles(df, x, [i / q for i in range(q + 1)]).select(F.array_distinct("percentiles").alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Index of the right-open bin, the last one closed; past the edges the last bin."""
    inner = F.size(F.filter(edges, lambda e: e <= x)) - 1
    last = F.size(edges) - 2
    return F.when(F.size(edges) < 2, 0).when(inner < 0, last).otherwise(F.least(inner, last))


def rank_class(df: DataFrame, rank: str, percent: float, names: tuple[str, str, str] = ("High_Hub", "Moderate_Hub", "Low_Hub")) -> DataFrame:
    """Three classes by rank: the top ``percent``, the top quarter, the rest."""
    n = F.col("__n")
    high, mid = F.greatest(F.lit(1), F.floor(n * percent / 100.0)), F.greatest(F.lit(2), F.floor(n * 0.25))
    counted = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))  # one row
    return counted.withColumn("rank_class", F.when(F.col(rank) <= high, names[0]).when(F.col(rank) <= mid, names[1]).otherwise(names[2])).drop("__n")


def threshold_counts(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """Per distinct score, from the highest: cumulative true and false positives, and the totals; null and NaN scores are left out.

    A first aggregation leaves a row a score, so the running sums see distinct scores alone.
    """
    by = list(by)
    per = df.filter(present(df, score)).groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos"))
    ran = running(per, [F.desc("score")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, by)
    total = per.groupBy(*[F.col(c).alias(f"__k_{c}") for c in by]).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    match = F.lit(True)
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    both = ran.join(total, match) if by else ran.crossJoin(F.broadcast(total))  # one row
    return both.select(*by, "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")


def auc_scores(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """ROC-AUC (trapezoids, so ties count half) and average precision (steps); null with one class only."""
    by = list(by)
    c = threshold_counts(df, score, label, by)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    out = c.groupBy(*by).agg(F.sum(area).alias("a"), F.sum(step).alias("s"), F.first("n_pos").alias("p"), F.first("n_neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(*by, F.when(both, F.col("a") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"), F.col("p").alias("n_pos"), F.col("n").alias("n_neg"))


def confusion(df: DataFrame, predicted: str, actual: str, by: list[str] = ()) -> DataFrame:
    """Counts and rates of a boolean prediction; a rate without cases is 0."""
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    c = df.groupBy(*by).agg(*(F.count_if(x).alias(n) for n, x in (("tp", p & a), ("fp", p & ~a), ("fn", ~p & a), ("tn", ~p & ~a))))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        *by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def top_k_enrichment(ranks: DataFrame, positives: DataFrame, ks: list[int], key: str, rank: str = "rank", universe: int | None = None, undefined: float | None = 0.0) -> DataFrame:
    """Per k: observed, expected, fold enrichment, precision and recall of the positives among the first k.

    One pass: a row counts for every k that its rank is within. Positives are counted within the
    ranked universe unless its size is given.
    """
    flags = ranks.join(positives.select(key).distinct().withColumn("__pos", F.lit(1)), key, "left").select(rank, F.coalesce("__pos", F.lit(0)).alias("pos"))
    total = flags.agg(F.count("*").alias("ranked"), F.sum("pos").alias("n_pos")).withColumn("universe", F.lit(universe) if universe else F.col("ranked"))
    hits = at_each_k(flags, ks, rank).groupBy("k").agg(F.count("*").alias("k_used"), F.sum("pos").alias("observed"))
    out = hits.crossJoin(F.broadcast(total))  # one row
    expected = F.col("k_used") * F.col("n_pos") / F.col("universe")
    return out.select(
        "k", "k_used", "observed", expected.alias("expected"), F.when(expected > 0, F.col("observed") / expected).otherwise(F.lit(undefined).cast("double")).alias("fold_enrichment"),
        (F.col("observed") / F.col("k_used")).alias("precision"), F.when(F.col("n_pos") > 0, F.col("observed") / F.col("n_pos")).otherwise(0.0).alias("recall"), "n_pos", "universe",
    )
