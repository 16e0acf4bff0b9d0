"""Roles of the driver's tables: results, samples, known items, ranked lists. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def volcano(spark: SparkSession, d: str) -> DataFrame:
    """Test results: a part is the entity; line number, flag and status are tissue, database and method."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.col("l_linenumber").alias("tissue"), F.col("l_returnflag").alias("database"), F.col("l_linestatus").alias("method"),
        (F.col("l_orderkey") % 5).alias("fold"), F.when(F.col("l_orderkey") % 3 == 0, "training").when(F.col("l_orderkey") % 3 == 1, "validation").otherwise("test").alias("dataset"),
        F.round((F.col("l_discount") - F.col("l_tax")) * 10, 6).alias("effect"), (F.col("l_quantity") / 51).alias("fdr"),
    )


VOLCANO = """volcano AS (
  SELECT l_partkey AS gene, l_linenumber AS tissue, l_returnflag AS database, l_linestatus AS method, l_orderkey % 5 AS fold,
         CASE l_orderkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'test' END AS dataset,
         round((l_discount - l_tax) * 10, 6) AS effect, l_quantity / 51 AS fdr FROM lineitem)"""

SIGNIFICANT = "sig AS (SELECT * FROM volcano WHERE fdr < 0.1 AND abs(effect) >= 0.5)"


def significant(spark: SparkSession, d: str) -> DataFrame:
    from evistrata.operators.tables import significant as rule

    return volcano(spark, d).filter(rule(F.col("fdr"), F.col("effect")))


def known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("gene"))


KNOWN = "known AS (SELECT p_partkey AS gene FROM part WHERE p_size > 40)"


def expression(spark: SparkSession, d: str) -> DataFrame:
    """Sample by gene values: a vector's components are genes, and labels below 5 are cases."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("label") < 5).cast("int").alias("status"), F.col("label").alias("batch"), F.posexplode("embedding").alias("gene", "value"))
    return v.withColumn("value", F.col("value").cast("double"))


EXPRESSION = """expression AS (
  SELECT vec_id AS sample, CAST(label < 5 AS INTEGER) AS status, label AS batch, gene, CAST(value AS DOUBLE) AS value FROM (
    SELECT vec_id, label, unnest(embedding) AS value, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS gene FROM embeddings))"""


def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    """A ranked list: parts by price, with a positive flag."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 40).cast("int").alias("positive"), F.col("p_brand").alias("brand"))


PARTS = "parts AS (SELECT p_partkey AS gene, p_retailprice AS score, CAST(p_size > 40 AS INTEGER) AS positive, p_brand AS brand FROM part)"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Gene and drug evidence: part, supplier, source and phase."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("drug"), F.when(F.col("l_returnflag") == "A", "OpenTargets").when(F.col("l_returnflag") == "N", "DGIdb").otherwise("ChEMBL").alias("source"),
        (F.col("l_linenumber") % 5).cast("string").alias("phase"), (F.col("l_linestatus") == "F").alias("approved"),
    )


EVIDENCE = """evidence AS (
  SELECT l_partkey AS gene, l_suppkey AS drug, CASE l_returnflag WHEN 'A' THEN 'OpenTargets' WHEN 'N' THEN 'DGIdb' ELSE 'ChEMBL' END AS source,
         CAST(l_linenumber % 5 AS VARCHAR) AS phase, l_linestatus = 'F' AS approved FROM lineitem)"""
