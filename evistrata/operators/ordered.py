"""Running totals, ranks and exact percentiles over a whole table, without one task that holds it.

Rows are parted by ranges of the order and written once. Within a part a window runs over its own
rows; what the parts before carry is one row a part, or one a part and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.written import checkpointed

START = Window.unboundedPreceding
FOLDS = {"sum": F.sum, "min": F.min}


def running(df: DataFrame, order: list[Column], totals: dict[str, tuple[str, Column]], by: list[str] = ()) -> DataFrame:
    """Add a column for each name: its ``sum`` or ``min`` from the group's first row up to each row.

    ``order`` must tell rows apart, or rows that it does not tell apart get their totals in any order.
    """
    by = list(by)
    parted = df.withColumns({f"__v_{n}": c for n, (_, c) in totals.items()}).repartitionByRange(*[F.col(c) for c in by], *order)
    t = checkpointed(parted.withColumn("__part", F.spark_partition_id()))
    per = t.groupBy(*by, "__part").agg(*(FOLDS[f](f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in totals.items()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(START, -1)  # one row a part
    carried = per.select(F.col("__part").alias("__c_part"), *[F.col(c).alias(f"__c_{c}") for c in by], *(FOLDS[f](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (f, _) in totals.items()))
    match = F.col("__part") == F.col("__c_part")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    joined = t.join(carried, match)
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(START, Window.currentRow)
    both = {}
    for name, (fold, _) in totals.items():
        here, earlier = FOLDS[fold](f"__v_{name}").over(own), F.col(f"__b_{name}")
        both[name] = here + F.coalesce(earlier, F.lit(0)) if fold == "sum" else F.least(here, earlier)
    return joined.withColumns(both).select(*df.columns, *totals)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in order."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))})


def present(df: DataFrame, x: str) -> Column:
    """Whether ``x`` has a value: a NaN is a missing value, and not the largest number."""
    known = F.col(x).isNotNull()
    return known & ~F.isnan(x) if dict(df.dtypes)[x] in ("double", "float") else known


def value_places(df: DataFrame, x: str, by: list[str] = (), descending: bool = False) -> DataFrame:
    """One row a group and distinct value: how many rows have it, and how many come up to it; nulls and NaN are left out."""
    per = df.filter(present(df, x)).groupBy(*by, x).agg(F.count("*").alias("__count"))
    return running(per, [F.desc(x) if descending else F.asc(x)], {"__upto": ("sum", F.col("__count"))}, by)


def with_average_rank(df: DataFrame, x: str, name: str, descending: bool = False) -> DataFrame:
    """Add the rank from 1 of ``x``, ties at the mean of their places, and ``<name>_n``, the number of values; null for null and NaN."""
    places = value_places(df, x, (), descending)
    n = places.agg(F.coalesce(F.sum("__count"), F.lit(0)).alias(f"{name}_n"))
    of_value = places.select(F.col(x).alias("__x"), (F.col("__upto") - (F.col("__count") - 1) / 2.0).alias(name))
    return df.join(of_value, F.col(x) == F.col("__x"), "left").drop("__x").crossJoin(F.broadcast(n))  # one row


def exact_percentiles(df: DataFrame, x: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """(by, n, percentiles): between the two nearest values by distance; no group, or no value, no row."""
    by = list(by)
    places = value_places(df, x, by)
    n = places.groupBy(*by).agg(F.sum("__count").alias("n"))
    match = F.lit(True)
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    joined = places.join(F.broadcast(n), match) if not by else places.join(n.withColumnsRenamed({c: f"__n_{c}" for c in by}), match).drop(*(f"__n_{c}" for c in by))  # one row without groups
    at = joined.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("pos", F.col("share") * (F.col("n") - 1))
    holds = lambda p: (p >= F.col("__upto") - F.col("__count")) & (p < F.col("__upto"))
    low, high = F.floor("pos"), F.ceil("pos")
    near = at.filter(holds(low) | holds(high))
    pairs = near.groupBy(*by, "n", "share", "pos").agg(F.max(F.when(holds(low), F.col(x))).alias("low"), F.max(F.when(holds(high), F.col(x))).alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((high - F.col("pos")) * F.col("low") + (F.col("pos") - low) * F.col("high"))
    return pairs.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("share", value.alias("v")))), lambda s: s["v"]).alias("percentiles"))
