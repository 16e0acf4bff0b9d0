"""Queries on ranks, corrected p-values, thresholds and ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.operators import ranking as R
from evistrata.operators.ordered import exact_percentiles
from evistrata.plans.registry import query
from evistrata.plans.views import KNOWN, PARTS, SIGNIFICANT, VOLCANO, known, scored_parts, significant, table, volcano

KS = [10, 20, 50, 100, 200]


@query("SELECT gene, score, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER (), 9) AS pct, round(1 - (rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () + 1e-6, 9) AS weight FROM parts", PARTS)
def w1_percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    both = R.gene_weight(R.percentile_rank(scored_parts(spark, d), "score", "pct"), "score", "weight")
    return both.select("gene", "score", F.round("pct", 9).alias("pct"), F.round("weight", 9).alias("weight"))


@query(
    """, p AS (SELECT gene, method, min(fdr) AS p FROM volcano GROUP BY ALL),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY method) / count(*) OVER (PARTITION BY method ORDER BY p) AS raw FROM p)
    SELECT gene, method, round(p, 9) AS p, round(least(1.0, min(raw) OVER (PARTITION BY method ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM r""",
    VOLCANO,
)
def w5_bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = volcano(spark, d).groupBy("gene", "method").agg(F.min("fdr").alias("p"))
    return R.benjamini_hochberg(p, "p", ["method"]).select("gene", "method", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(
    "SELECT gene, tissue, database, method, fold, dataset, effect, round(fdr, 9) AS fdr FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY fdr, abs(effect) DESC, tissue, database, method, fold, dataset, effect) AS n FROM volcano) WHERE n = 1",
    VOLCANO,
)
def w6_best_row(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("fdr"), F.abs("effect").desc(), *map(F.col, ("tissue", "database", "method", "fold", "dataset", "effect"))]
    return R.best_row(volcano(spark, d), ["gene"], order).withColumn("fdr", F.round("fdr", 9))


@query(
    "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3"
)
def w3_numbered_in_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return R.ranked(o, [F.desc("price"), F.asc("orderkey")], ["custkey"], "place").filter("place <= 3")


@query("SELECT brand, max(score) AS best, arg_max(gene, (score, -gene)) AS gene FROM parts GROUP BY brand", PARTS)
def a30_best_of_group(spark: SparkSession, d: str) -> DataFrame:
    return scored_parts(spark, d).groupBy("brand").agg(F.max("score").alias("best"), F.max_by("gene", F.struct("score", -F.col("gene"))).alias("gene"))


@query(
    """, e AS (SELECT quantile_cont(score, 0) AS e0, quantile_cont(score, .25) AS e1, quantile_cont(score, .5) AS e2, quantile_cont(score, .75) AS e3 FROM parts)
    SELECT CASE WHEN score >= e3 THEN 3 WHEN score >= e2 THEN 2 WHEN score >= e1 THEN 1 ELSE 0 END AS bin, count(*) AS n, min(score) AS low, max(score) AS high FROM parts, e GROUP BY 1""",
    PARTS,
)
def w9_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    parts = scored_parts(spark, d)
    binned = parts.crossJoin(F.broadcast(R.quantile_edges(parts, "score", 4))).select("score", R.bin_of(F.col("score"), F.col("edges")).alias("bin"))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(
    "SELECT rank_class, count(*) AS n, min(rank) AS first, max(rank) AS last FROM (SELECT rank, CASE WHEN rank <= greatest(1, floor(n * 0.1)) THEN 'High_Hub' WHEN rank <= greatest(2, floor(n * 0.25)) THEN 'Moderate_Hub' ELSE 'Low_Hub' END AS rank_class FROM (SELECT row_number() OVER (ORDER BY score DESC, gene) AS rank, count(*) OVER () AS n FROM parts)) GROUP BY 1",
    PARTS,
)
def w10_rank_class(spark: SparkSession, d: str) -> DataFrame:
    r = R.ranked(scored_parts(spark, d), [F.desc("score"), F.asc("gene")])
    return R.rank_class(r, "rank", 10).groupBy("rank_class").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))


@query("SELECT gene, score FROM parts WHERE score >= (SELECT quantile_cont(score, 0.75) FROM parts)", PARTS)
def w11_top_quartile(spark: SparkSession, d: str) -> DataFrame:
    parts = scored_parts(spark, d)
    return parts.crossJoin(F.broadcast(exact_percentiles(parts, "score", [0.75]).select(F.col("percentiles")[0].alias("q")))).filter("score >= q").select("gene", "score")  # one row


@query("SELECT gene, score FROM parts ORDER BY score DESC, gene LIMIT 50", PARTS)
def w12_top_n(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(scored_parts(spark, d).select("gene", "score"), [F.desc("score"), F.asc("gene")], 50)


@query(
    """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM parts), t AS (SELECT count(*) AS universe, sum(positive) AS n_pos FROM parts),
    h AS (SELECT k, count(*) AS k_used, sum(positive) AS observed FROM r, (SELECT unnest([10, 20, 50, 100, 200]) AS k) WHERE rank <= k GROUP BY k)
    SELECT k, k_used, CAST(observed AS BIGINT) AS observed, round(k_used * n_pos / universe, 9) AS expected, round(observed / (k_used * n_pos / universe), 9) AS fold_enrichment,
           round(observed / k_used, 9) AS precision, round(observed / n_pos, 9) AS recall, CAST(n_pos AS BIGINT) AS n_pos, universe FROM h, t""",
    PARTS,
)
def m24_top_k_enrichment(spark: SparkSession, d: str) -> DataFrame:
    parts = scored_parts(spark, d)
    r = R.ranked(parts, [F.desc("score"), F.asc("gene")])
    out = R.top_k_enrichment(r, parts.filter("positive = 1"), KS, "gene")
    return out.withColumns({c: F.round(c, 9) for c in ("expected", "fold_enrichment", "precision", "recall")})


AUC = """, s AS (SELECT brand, score, sum(positive) AS pos, count(*) - sum(positive) AS neg FROM {src} GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY brand) AS p, sum(neg) OVER (PARTITION BY brand) AS n FROM s WINDOW w AS (PARTITION BY brand ORDER BY score DESC))
    SELECT brand, round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos / 2)) / (max(p) * max(n)) END, 9) AS roc_auc,
           round(CASE WHEN max(p) > 0 THEN sum(pos * (tp / (tp + fp))) / max(p) END, 9) AS average_precision, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM c GROUP BY brand"""


@query(AUC.format(src="parts"), PARTS)
def m20_m21_auc(spark: SparkSession, d: str) -> DataFrame:
    out = R.auc_scores(scored_parts(spark, d), "score", "positive", ["brand"])
    return out.withColumns({c: F.round(c, 9) for c in ("roc_auc", "average_precision")})


@query(
    """, l AS (SELECT n_chars // 500 AS score, quality AS positive, lang AS brand FROM labels JOIN documents USING (doc_id)) """ + AUC.format(src="l").replace("SELECT brand, round(CASE", "SELECT brand AS lang, round(CASE"),
    PARTS,
)
def m20_auc_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """Document length in steps as a score for labelled quality."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = R.auc_scores(rows.withColumn("score", F.floor(F.col("n_chars") / 500)), "score", "quality", ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("roc_auc", "average_precision")})


@query(
    """, s AS (SELECT DISTINCT gene FROM sig WHERE dataset <> 'test'), c AS (
      SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn
      FROM (SELECT gene IN (SELECT gene FROM s) AS a, gene IN (SELECT gene FROM known) AS b FROM (SELECT DISTINCT gene FROM volcano)))
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
           round(tn / (tn + fp), 9) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy FROM c""",
    VOLCANO,
    SIGNIFICANT,
    KNOWN,
)
def m23_confusion(spark: SparkSession, d: str) -> DataFrame:
    from evistrata.operators.sets import membership

    flags = membership("gene", universe=volcano(spark, d), found=significant(spark, d).filter("dataset <> 'test'"), known=known(spark, d)).filter("universe")
    out = R.confusion(flags, "found", "known")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "specificity", "accuracy")})


@query(
    """, r AS (SELECT unnest(range(0, 1001)) AS rep), o AS (
      SELECT rep, p.gene, score, positive, row_number() OVER (PARTITION BY rep ORDER BY gene) AS i,
             row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5(concat_ws(':', '42', CAST(rep AS VARCHAR), CAST(gene AS VARCHAR))) END, gene) AS j FROM parts p, r),
    x AS (SELECT a.rep AS brand, b.score, a.positive FROM o a JOIN o b ON a.rep = b.rep AND a.i = b.j)"""
    + AUC.format(src="x").replace("SELECT brand, round(CASE", ", z AS (SELECT brand AS rep, (CASE").replace("END, 9) AS roc_auc", "END) AS roc_auc").replace("round(CASE WHEN max(p) > 0 THEN sum(pos * (tp / (tp + fp))) / max(p) END, 9)", "(CASE WHEN max(p) > 0 THEN sum(pos * (tp / (tp + fp))) / max(p) END)")
    + """), m AS (SELECT rep, 'ROC_AUC' AS metric, round(roc_auc, 12) AS a FROM z UNION ALL SELECT rep, 'PR_AUC', round(average_precision, 12) FROM z)
    SELECT metric, round(max(o), 9) AS observed, round(avg(a), 6) AS null_mean, round(stddev_pop(a), 6) AS null_sd, round((1 + count(*) FILTER (WHERE a >= o)) / 1001, 9) AS p
    FROM m JOIN (SELECT metric, a AS o FROM m WHERE rep = 0) USING (metric) WHERE rep > 0 GROUP BY metric""",
    PARTS,
)
def m22_auc_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Both areas of the part ranking against a thousand shuffles of its scores."""
    from evistrata.operators.permutation import permuted_auc

    out = permuted_auc(scored_parts(spark, d), reps=1000)
    return out.select("metric", F.round("observed", 9).alias("observed"), F.round("null_mean", 6).alias("null_mean"), F.round("null_sd", 6).alias("null_sd"), F.round("p", 9).alias("p"))
