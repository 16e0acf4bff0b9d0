"""Graph operators on edge tables: components, degrees, centrality, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.operators.written import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge; a component is its smallest node.

    Rounds of large-star and small-star on the edge table: a node's neighbours are linked to its
    smallest one, until every edge points at a component's smallest node. A round shuffles the
    edges twice and aggregates before each shuffle, so a hub is no hot key of a join on itself.
    Null ends and self loops are dropped.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    links = checkpointed(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, F.col("u") == F.col("m_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("m_u"))
        links = checkpointed(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def induced(edges: DataFrame, nodes: DataFrame, least: float = 0.0, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Undirected edges (u < v, w) between the given nodes with a weight of at least ``least``; no loops, the heaviest of duplicates.

    The nodes are shuffled to the edges, however few they are, and none goes to the driver.
    """
    n = nodes.select("node").distinct().hint("merge")
    e = edges.filter((F.col(src) != F.col(dst)) & (F.col(weight) >= least)).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"), F.col(weight).alias("w"))
    kept = e.join(n.withColumnRenamed("node", "u"), "u", "left_semi").join(n.withColumnRenamed("node", "v"), "v", "left_semi")
    return kept.groupBy("u", "v").agg(F.max("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def strengths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree and summed absolute weight of each node; isolated ones among ``nodes`` get 0."""
    per = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum(F.abs("w")).alias("strength"))
    return per if nodes is None else nodes.select("node").distinct().join(per, "node", "left").na.fill(0)


def modules(edges: DataFrame, least: int = 10) -> DataFrame:
    """(node, module) of components with at least ``least`` nodes."""
    c = connected_components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    big = c.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("component")
    return c.join(big, "component", "left_semi").select("node", F.col("component").alias("module"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, pagerank) of an undirected weighted graph; nodes without edges share their rank with all.

    Rounds end when the ranks change by less than ``tolerance`` a node in sum. A round reads and
    writes one table of a row a node; two numbers of it go to the driver.
    """
    arcs = both_ways(edges)
    out = arcs.groupBy("u").agg(F.sum("w").alias("total"))
    share = checkpointed(arcs.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")))
    rank = nodes.select("node").distinct().join(out.select(F.col("u").alias("node"), F.lit(False).alias("loose")), "node", "left").select("node", F.coalesce("loose", F.lit(True)).alias("loose"))
    n = rank.count()
    rank = checkpointed(rank.withColumn("r", F.lit(1.0 / max(1, n))).withColumn("change", F.lit(1.0)))
    for _ in range(rounds):
        change, loose = rank.agg(F.sum("change"), F.coalesce(F.sum(F.when(F.col("loose"), F.col("r"))), F.lit(0.0))).first()
        if change is None or change < n * tolerance:
            break
        got = rank.join(share, rank["node"] == share["u"]).groupBy("v").agg(F.sum(F.col("r") * F.col("p")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
        rank = checkpointed(rank.join(got, F.col("node") == F.col("v"), "left").select("node", "loose", new.alias("r"), F.abs(new - F.col("r")).alias("change")))
    return rank.select("node", F.col("r").alias("pagerank"))


def preservation(mods: DataFrame, fold: str, module: str, node: str) -> DataFrame:
    """Per module of a fold its best Jaccard similarity with a module of each other fold, averaged."""
    size = mods.groupBy(fold, module).agg(F.count("*").alias("n"))
    a, b = (mods.select(F.col(fold).alias(f"f_{x}"), F.col(module).alias(f"m_{x}"), node) for x in "ab")
    shared = a.join(b, node).filter("f_a <> f_b").groupBy("f_a", "m_a", "f_b", "m_b").agg(F.count("*").alias("s"))
    na, nb = (size.select(F.col(fold).alias(f"f_{x}"), F.col(module).alias(f"m_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    best = shared.join(na, ["f_a", "m_a"]).join(nb, ["f_b", "m_b"]).groupBy("f_a", "m_a", "f_b").agg(F.max(F.col("s") / (F.col("n_a") + F.col("n_b") - F.col("s"))).alias("j"))
    others = mods.agg((F.count_distinct(fold) - 1).alias("others"))
    per = best.groupBy("f_a", "m_a").agg(F.sum("j").alias("j"))
    every = size.select(F.col(fold).alias("f_a"), F.col(module).alias("m_a")).join(per, ["f_a", "m_a"], "left").crossJoin(F.broadcast(others))  # one row
    return every.select(F.col("f_a").alias(fold), F.col("m_a").alias(module), (F.coalesce("j", F.lit(0.0)) / F.greatest(F.lit(1), F.col("others"))).alias("preservation"))


def without_shared_predictors(edges: DataFrame, predictors: DataFrame, most: float = 0.25, gene: str = "gene", snp: str = "snp") -> DataFrame:
    """Edges (u, v) whose genes' predictors have a Jaccard similarity below ``most``; genes without predictors share none.

    Predictors are met along the edges alone, so pairs of genes without an edge never arise.
    """
    own = predictors.select(gene, snp).distinct()
    sizes = own.groupBy(gene).agg(F.count("*").alias("n"))
    pairs = edges.select("u", "v").distinct()
    a, b = (own.select(F.col(gene).alias(x), F.col(snp).alias("s")) for x in "uv")
    shared = pairs.join(a, "u").join(b, ["v", "s"]).groupBy("u", "v").agg(F.count("*").alias("shared"))
    nu, nv = (sizes.select(F.col(gene).alias(x), F.col("n").alias(f"n_{x}")) for x in "uv")
    close = shared.join(nu, "u").join(nv, "v").filter(F.col("shared") >= most * (F.col("n_u") + F.col("n_v") - F.col("shared")))
    return edges.join(close.select("u", "v"), ["u", "v"], "left_anti")
