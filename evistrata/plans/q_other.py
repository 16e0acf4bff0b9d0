"""Queries on windows of time, report data and pocket scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.functions import numeric as N
from evistrata.functions import text as X
from evistrata.operators import causal as C
from evistrata.operators import tables as T
from evistrata.plans.registry import query
from evistrata.plans.views import SIGNIFICANT, VOLCANO, evidence, significant, table, volcano
from evistrata.sources.writers import plot_data
from evistrata.streaming.ingest import windowed_counts


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def t1_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "ts", "event_type").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT round(round(effect * 5, 0) / 5, 6) AS effect, round(round(-log10(fdr) * 4, 0) / 4, 6) AS neg_log10_fdr, count(*) AS n FROM volcano GROUP BY ALL", VOLCANO)
def k6_plot_data(spark: SparkSession, d: str) -> DataFrame:
    return plot_data(volcano(spark, d), "effect", "fdr").select(F.round("effect", 6).alias("effect"), F.round("neg_log10_fdr", 6).alias("neg_log10_fdr"), "n")


@query(
    """SELECT l_partkey AS partkey, l_linenumber AS linenumber, round(max((0.35 * least(s, 1) + 0.25 * CASE WHEN v BETWEEN 500 AND 2000 THEN 1 WHEN v < 500 THEN v / 500 ELSE greatest(0.3, 2000 / v) END
      + CASE WHEN h IS NULL THEN 0 ELSE 0.2 * CASE WHEN h BETWEEN 0.3 AND 0.7 THEN 1 WHEN h < 0.3 THEN greatest(0.5, h / 0.3) ELSE greatest(0.3, (1 - h) / 0.5) END END) / (0.6 + CASE WHEN h IS NULL THEN 0 ELSE 0.2 END)), 6) AS probability
    FROM (SELECT *, l_discount * 12 AS s, l_extendedprice / 20 AS v, CASE WHEN l_linenumber > 3 THEN l_quantity / 50 END AS h FROM lineitem) GROUP BY ALL"""
)
def f15_a36_pockets(spark: SparkSession, d: str) -> DataFrame:
    """Pocket probability from the descriptors there are, and the best of each entity and part."""
    null = F.lit(None).cast("double")
    p = N.pocket_probability(F.col("l_discount") * 12, F.col("l_extendedprice") / 20, F.when(F.col("l_linenumber") > 3, F.col("l_quantity") / 50), null, null)
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("linenumber")).agg(F.round(F.max(p), 6).alias("probability"))


@query("SELECT l_linenumber AS linenumber, round(max(l_extendedprice / CASE WHEN m <= 1 THEN 1 WHEN m <= 1000 THEN 1000 ELSE m END), 9) AS scaled FROM lineitem, (SELECT max(l_extendedprice) AS m FROM lineitem) GROUP BY 1")
def f16_scaled_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    both = li.crossJoin(F.broadcast(li.agg(F.max("l_extendedprice").alias("m"))))  # one row
    return both.groupBy(F.col("l_linenumber").alias("linenumber")).agg(F.round(F.max(N.scaled_edges(F.col("l_extendedprice"), F.col("m"))), 9).alias("scaled"))


@query("SELECT p_partkey AS partkey, p_size AS denominator, CAST(p_size % 5 AS INTEGER) AS features, p_brand AS tissue FROM part")
def f17_f19_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = X.file_name_parts(F.concat("p_brand", F.lit("_LR_"), (F.col("p_size") % 5).cast("string"), F.lit("F_features.csv")))
    return p.select(F.col("p_partkey").alias("partkey"), X.ratio_part(F.concat(F.lit("3/"), F.col("p_size").cast("string"))).alias("denominator"), name["features"].alias("features"), name["tissue"].alias("tissue"))


@query("SELECT p_partkey AS snp, round((abs(avg(CASE WHEN c THEN CAST(dose = 0 AS INTEGER) END) - avg(CASE WHEN NOT c THEN CAST(dose = 0 AS INTEGER) END)) + abs(avg(CASE WHEN c THEN CAST(dose = 1 AS INTEGER) END) - avg(CASE WHEN NOT c THEN CAST(dose = 1 AS INTEGER) END)) + abs(avg(CASE WHEN c THEN CAST(dose = 2 AS INTEGER) END) - avg(CASE WHEN NOT c THEN CAST(dose = 2 AS INTEGER) END))) * CASE WHEN count(DISTINCT CASE WHEN c THEN dose END) > 1 AND count(DISTINCT CASE WHEN NOT c THEN dose END) > 1 THEN 1.5 ELSE 1 END, 6) AS variation FROM (SELECT l_partkey AS p_partkey, l_linenumber % 3 AS dose, s_acctbal > 4000 AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1")
def f22_variation(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").select(F.col("l_partkey").alias("snp"), F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 3).cast("double").alias("dosage"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_acctbal") > 4000).cast("int").alias("status"))
    return C.variation_scores(g, s).withColumn("variation", F.round("variation", 6))


@query("SELECT p_brand AS brand, count(*) AS n, CAST(min(p_partkey) FILTER (WHERE p_size > 25) AS BIGINT) AS first_large FROM part GROUP BY 1")
def a28_first_in_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), T.first_by(F.when(F.col("p_size") > 25, F.col("p_partkey")), "p_partkey").alias("first_large"))


@query("SELECT a.database AS a, b.database AS b, round(corr(a.n, b.n), 6) AS r, CASE WHEN corr(a.n, b.n) >= 0.7 THEN 'high' WHEN corr(a.n, b.n) >= 0.5 THEN 'moderate' WHEN corr(a.n, b.n) < 0.3 THEN 'low' ELSE 'between' END AS band FROM (SELECT database, tissue, fold, count(*) AS n FROM sig GROUP BY ALL) a JOIN (SELECT database, tissue, fold, count(*) AS n FROM sig GROUP BY ALL) b ON a.tissue = b.tissue AND a.fold = b.fold AND a.database < b.database GROUP BY ALL", VOLCANO, SIGNIFICANT)
def a34_j19_correlation_bands(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of databases by the correlation of their counts over tissues and folds."""
    n = significant(spark, d).groupBy("database", "tissue", "fold").agg(F.count("*").alias("n"))
    pair = n.select(F.col("database").alias("a"), "tissue", "fold", F.col("n").alias("na")).join(n.select(F.col("database").alias("b"), "tissue", "fold", F.col("n").alias("nb")), ["tissue", "fold"]).filter("a < b")
    r = pair.groupBy("a", "b").agg(F.corr("na", "nb").alias("r"))
    return r.select("a", "b", F.round("r", 6).alias("r"), F.when(F.col("r") >= 0.7, "high").when(F.col("r") >= 0.5, "moderate").when(F.col("r") < 0.3, "low").otherwise("between").alias("band"))


@query("SELECT source, phase, count(*) AS n FROM (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'OpenTargets' WHEN 'N' THEN 'DGIdb' ELSE 'ChEMBL' END AS source, CAST(l_linenumber % 5 AS VARCHAR) AS phase FROM lineitem) GROUP BY ALL")
def a19_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).groupBy("source", "phase").agg(F.count("*").alias("n"))
