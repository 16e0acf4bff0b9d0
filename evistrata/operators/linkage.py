"""Average-linkage clustering of a table of distances, in rounds that merge every reciprocal nearest pair.

A pair of clusters is a row with the sum and the number of distances between their members, so
merging is a sum over renamed rows. Clusters that are each other's nearest merge at once: average
distances never bring a third cluster nearer than the two it averages, so the tree is that of one
merge after another. A cluster is named by its smallest member.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.operators.graph import connected_components
from evistrata.operators.ordered import running
from evistrata.operators.written import checkpointed


def average_linkage(distances: DataFrame, by: list[str] = (), a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """(by, step, left, right, distance, size): the merges from the nearest on, ``left`` < ``right`` by their smallest members.

    ``distances`` has each pair of items once, in any direction. Of equal distances the pair with the
    smaller names merges first. Pairs that are missing, null or NaN do not enter the average; what no
    distance ties together never merges. Items paired with themselves are left out.
    """
    by = list(by)
    d = F.col(distance).cast("double")
    first = distances.filter((F.col(a) != F.col(b)) & d.isNotNull() & ~F.isnan(d))
    pairs = checkpointed(first.groupBy(*by, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.sum(d).alias("total"), F.count("*").alias("n")))
    ends = pairs.select(*by, F.col("lo").alias("item")).unionByName(pairs.select(*by, F.col("hi").alias("item")))
    sizes = checkpointed(ends.distinct().withColumn("size", F.lit(1).cast("long")))
    merges: list[DataFrame] = []
    while not pairs.isEmpty():
        # A total order of pairs: the first pair of all is its two ends' nearest, so every round merges.
        place = F.struct((F.col("total") / F.col("n")).alias("d"), "lo", "hi")
        near = pairs.select(*by, F.array("lo", "hi").alias("ends"), place.alias("p")).select(*by, F.explode("ends").alias("item"), "p").groupBy(*by, "item").agg(F.min("p").alias("p"))
        both = near.groupBy(*by, "p").agg(F.count("*").alias("ends")).filter("ends = 2").select(*by, F.col("p.lo").alias("left"), F.col("p.hi").alias("right"), F.col("p.d").alias("distance"))
        left, right = (sizes.select(*by, F.col("item").alias(x), F.col("size").alias(f"n_{x}")) for x in ("left", "right"))
        merged = checkpointed(both.join(left, [*by, "left"]).join(right, [*by, "right"]).select(*by, "left", "right", "distance", (F.col("n_left") + F.col("n_right")).alias("size")))
        merges.append(merged)
        grown = merged.select(*by, F.col("left").alias("item"), F.col("size").alias("grown"))
        gone = merged.select(*by, F.col("right").alias("item"))
        sizes = checkpointed(sizes.join(gone, [*by, "item"], "left_anti").join(grown, [*by, "item"], "left").select(*by, "item", F.coalesce("grown", "size").alias("size")))
        for end in ("lo", "hi"):
            renamed = merged.select(*by, F.col("right").alias(end), F.col("left").alias("__to"))
            pairs = pairs.join(renamed, [*by, end], "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        kept = pairs.filter("lo <> hi").groupBy(*by, F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        pairs = checkpointed(kept.agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    if not merges:
        return pairs.select(*by, F.lit(0).cast("long").alias("step"), F.col("lo").alias("left"), F.col("hi").alias("right"), F.col("total").alias("distance"), F.col("n").alias("size"))
    every = reduce(DataFrame.unionByName, merges)
    order = [F.asc("distance"), F.asc("size"), F.asc("left"), F.asc("right")]
    return running(every, order, {"step": ("sum", F.lit(1).cast("long"))}, by).select(*by, "step", "left", "right", "distance", "size")


def cut(merges: DataFrame, most: float) -> DataFrame:
    """(node, component) of the clusters that merges up to a distance make; items that none of these merges touches have no row."""
    return connected_components(merges.filter(F.col("distance") <= most), "left", "right")
