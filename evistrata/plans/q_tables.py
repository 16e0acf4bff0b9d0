"""Queries on filters, reshaping, joins, roll-ups and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.functions import numeric as N
from evistrata.functions import text as X
from evistrata.operators import ranking as R
from evistrata.operators import sets as U
from evistrata.operators import tables as T
from evistrata.plans.registry import query
from evistrata.plans.views import EVIDENCE, EXPRESSION, KNOWN, PARTS, SIGNIFICANT, VOLCANO, evidence, expression, known, scored_parts, significant, table, volcano


@query("SELECT database, tissue, count(*) AS n, count(DISTINCT gene) AS n_genes FROM sig GROUP BY ALL", VOLCANO, SIGNIFICANT)
def p3_significant_counts(spark: SparkSession, d: str) -> DataFrame:
    return significant(spark, d).groupBy("database", "tissue").agg(F.count("*").alias("n"), F.count_distinct("gene").alias("n_genes"))


@query(
    """, u AS (SELECT *, CASE WHEN method = 'F' THEN effect ELSE coalesce(nullif(effect, 0), fdr) END AS unified FROM volcano)
    SELECT method, count(*) AS n, round(sum(unified), 4) AS total FROM u WHERE fdr < 0.1 AND abs(unified) >= 0.5 GROUP BY method""",
    VOLCANO,
)
def p3_class_specific(spark: SparkSession, d: str) -> DataFrame:
    v = volcano(spark, d).withColumn("assoc", F.nullif("effect", F.lit(0.0))).withColumn("lfc", F.when(F.col("method") == "F", F.col("effect")).otherwise(F.col("fdr")))
    s = T.significant_by_class(v, "method", ["F"], "fdr", "lfc", "assoc", 0.1, 0.5)
    return s.groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("unified_effect"), 4).alias("total"))


@query(
    """, f AS (SELECT CASE WHEN tissue % 2 = 0 THEN effect END AS a, effect + 1 AS b, CASE WHEN fold = 0 THEN fdr END AS p, fdr / 2 AS q FROM volcano)
    SELECT CASE WHEN a IS NOT NULL THEN 'a' ELSE 'b' END AS effect_source, CASE WHEN p IS NOT NULL THEN 'p' ELSE 'q' END AS p_source, count(*) AS n, round(sum(coalesce(a, b)), 4) AS effects, round(sum(coalesce(p, q)), 4) AS ps FROM f GROUP BY ALL""",
    VOLCANO,
)
def p4_fallback_columns(spark: SparkSession, d: str) -> DataFrame:
    v = volcano(spark, d).select(F.when(F.col("tissue") % 2 == 0, F.col("effect")).alias("a"), (F.col("effect") + 1).alias("b"), F.when(F.col("fold") == 0, F.col("fdr")).alias("p"), (F.col("fdr") / 2).alias("q"))
    u = T.with_fallback(v, ["a", "b"], ["p", "q"])
    return u.groupBy(F.col("used_effect_source").alias("effect_source"), F.col("used_p_source").alias("p_source")).agg(F.count("*").alias("n"), F.round(F.sum("used_effect"), 4).alias("effects"), F.round(F.sum("used_p"), 4).alias("ps"))


@query("SELECT gene, round(max(least(-log10(least(greatest(fdr, 1e-50), 1)), 100)), 6) AS top, count(*) AS n FROM volcano WHERE abs(effect) <= 0.7 GROUP BY gene", VOLCANO)
def p5_clean_volcano(spark: SparkSession, d: str) -> DataFrame:
    return T.clean_volcano(volcano(spark, d), "effect", "fdr", most_effect=0.7).groupBy("gene").agg(F.round(F.max("neg_log10_fdr"), 6).alias("top"), F.count("*").alias("n"))


@query("SELECT tissue, count(*) AS n FROM volcano, (SELECT avg(CASE WHEN abs(effect) > 0.5 THEN 1.0 ELSE 0.0 END) AS lost FROM volcano) WHERE abs(effect) <= CASE WHEN lost > 0.05 THEN 0.8 ELSE 0.5 END GROUP BY tissue", VOLCANO)
def p6_trim_outliers(spark: SparkSession, d: str) -> DataFrame:
    return T.trim_outliers(volcano(spark, d), "effect", 0.5, 0.8).groupBy("tissue").agg(F.count("*").alias("n"))


@query("SELECT gene, count(*) AS n FROM volcano WHERE gene IN (SELECT gene FROM volcano GROUP BY gene HAVING var_samp(effect) >= 0.15) GROUP BY gene", VOLCANO)
def p7_varying_genes(spark: SparkSession, d: str) -> DataFrame:
    return T.varying(volcano(spark, d), "gene", "effect", least=0.15).groupBy("gene").agg(F.count("*").alias("n"))


QUALITY = "quality AS (SELECT fold, gene, avg(CASE WHEN effect = 0 THEN 1.0 ELSE 0.0 END) AS missing_rate, var_samp(nullif(effect, 0)) AS variance FROM volcano GROUP BY ALL HAVING avg(CASE WHEN effect = 0 THEN 1.0 ELSE 0.0 END) <= 0.25 AND var_samp(nullif(effect, 0)) >= 1e-8)"


def quality(spark: SparkSession, d: str) -> DataFrame:
    return T.gene_quality(volcano(spark, d).withColumn("value", F.nullif("effect", F.lit(0.0))), "gene", "value", ["fold"])


@query("SELECT fold, gene, round(missing_rate, 6) AS missing_rate, round(variance, 6) AS variance FROM quality", VOLCANO, QUALITY)
def p8_gene_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality(spark, d).select("fold", "gene", F.round("missing_rate", 6).alias("missing_rate"), F.round("variance", 6).alias("variance"))


@query("SELECT gene, round(median(round(variance, 9)), 6) AS median_variance FROM quality GROUP BY gene HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM quality) ORDER BY median(round(variance, 9)) DESC, gene LIMIT 100", VOLCANO, QUALITY)
def p9_consistent_genes(spark: SparkSession, d: str) -> DataFrame:
    q = quality(spark, d).withColumn("variance", F.round("variance", 9))
    return T.consistent_genes(q, "fold", "gene", 100).withColumn("median_variance", F.round("median_variance", 6))


@query("SELECT gene, count(*) AS n FROM volcano WHERE gene IN (SELECT gene FROM volcano GROUP BY gene HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM volcano)) GROUP BY gene", VOLCANO)
def p10_in_all_splits(spark: SparkSession, d: str) -> DataFrame:
    return T.in_all_splits(volcano(spark, d), "gene", "fold").groupBy("gene").agg(F.count("*").alias("n"))


@query("SELECT dataset, count(*) AS n, count(*) FILTER (WHERE contains(dataset, 'val') OR contains(dataset, 'test')) AS held FROM volcano GROUP BY dataset", VOLCANO)
def p11_split_labels(spark: SparkSession, d: str) -> DataFrame:
    v = volcano(spark, d)
    return v.groupBy(X.split_label(F.upper("dataset")).alias("dataset")).agg(F.count("*").alias("n"), F.count_if(X.contains_any(F.col("dataset"), ["VAL", "test"])).alias("held"))


@query(
    """, s AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, CAST(quality AS DOUBLE) AS sex, round((n_chars - m) / s, 6) AS chars_z FROM s JOIN documents USING (doc_id), (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM labels JOIN documents USING (doc_id))"""
    .replace(", s AS", "WITH s AS", 1)
)
def p17_covariates(spark: SparkSession, d: str) -> DataFrame:
    """Codes as sex, and lengths as a covariate, imputed and standardised."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars_z")), "doc_id")
    out = T.standardised(rows.select("doc_id", T.coded_sex(F.when(F.col("quality") == 1, "Male").otherwise("female"), F.lit(False)).alias("sex"), "chars_z"), ["chars_z"])
    return out.select("doc_id", "sex", F.round("chars_z", 6).alias("chars_z"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_high FROM events GROUP BY user_id HAVING count(*) >= 5")
def a26_mean_interval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(*T.normal_interval("value")).filter("n >= 5")
    return e.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "ci_low", "ci_high")})


@query("SELECT c_custkey AS custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS closed, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def j1_key_alignment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), (F.col("o_orderstatus") == "F").cast("int").alias("closed"))
    return c.join(o, "custkey").groupBy("custkey", "closed").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT l_suppkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_linenumber = 7 AND l_suppkey % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, sum(l_quantity) AS y FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 3 < 2 GROUP BY 1) b ON a.k = b.k")
def j4_full_merge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey"))
    part = lambda n, cond, name: li.filter((F.col("l_linenumber") == n) & cond).groupBy("k").agg(F.sum("l_quantity").alias(name))
    return T.full_merge([part(7, F.col("k") % 3 > 0, "x"), part(1, F.col("k") % 3 < 2, "y")], ["k"])


@query("SELECT s_suppkey AS suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09 GROUP BY 1) ON s_suppkey = l_suppkey")
def j8_dense_units(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").filter("l_quantity >= 50 AND l_discount > 0.09").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"))
    return T.dense_units(table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey")), n, "suppkey")


@query("SELECT o_orderkey AS orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND epoch(l_shipdate) BETWEEN epoch(o_orderdate) AND epoch(o_orderdate) + 2592000 GROUP BY 1")
def j10_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped within thirty days of their order, as a range join within the order."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), at("l_shipdate").alias("at"), "l_quantity")
    span = 30 * 86_400_000_000
    ranges = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), at("o_orderdate").alias("low"), (at("o_orderdate") + span).alias("high"))
    return T.range_join(points, ranges, "at", "low", "high", span, ["orderkey"]).groupBy("orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT s_suppkey AS suppkey, count(c_custkey) AS n, min(c_custkey) AS first FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal AND s_acctbal + [0.0, 1.0, 30.0, 1000.0, 20000.0][s_suppkey % 5 + 1] GROUP BY 1""")
def j10_mixed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Customers in balance ranges from a single value to more than all of them."""
    points = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("at"))
    span = F.element_at(F.array(*map(F.lit, (0.0, 1.0, 30.0, 1000.0, 20000.0))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    ranges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + span).alias("high"))
    return T.range_summary(points, ranges, "at", "low", "high", "suppkey", "c_custkey")


@query(
    """SELECT gene, count(*) AS n, round(avg(effect), 9) + 0.0 AS mean, round(stddev_samp(effect), 9) AS std, min(effect) AS low, max(effect) AS high, count(DISTINCT fold) AS n_fold, count(DISTINCT tissue) AS n_tissue FROM volcano GROUP BY gene""",
    VOLCANO,
)
def a10_incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """The test results in three batches by fold, each a table of states, one of them written twice; then their merge."""
    from evistrata.operators.written import new_folder
    from evistrata.streaming import folds

    v, target = volcano(spark, d), new_folder(spark, "states")
    for batch in (0, 1, 1, 2):
        folds.fold_in(v.filter(F.col("fold") % 3 == batch), batch, target, ["gene"], "effect", ["fold"], ["tissue"])
    out = folds.summary(folds.state(spark, target, ["gene"]), ["gene"])
    return out.select("gene", "n", (F.round("mean", 9) + 0.0).alias("mean"), F.round("std", 9).alias("std"), "low", "high", "n_fold", "n_tissue")


@query("SELECT o_custkey AS custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 GROUP BY 1")
def s9_block_gzip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as block gzip text and read in ranges: types from the first rows, some columns, filters in the reader."""
    from evistrata.operators.written import new_folder
    from evistrata.sources.blocked import blocked_table, write_blocked

    path = new_folder(spark, "blocked")
    write_blocked(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    rows = blocked_table(spark, path, range_bytes=1_000_000).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 1000))
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.s_suppkey AS suppkey, count(*) AS n FROM supplier a JOIN supplier b ON b.s_acctbal BETWEEN a.s_acctbal - 100 AND a.s_acctbal + 100 GROUP BY 1")
def j11_window_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose balance lies within a window around another's."""
    s = table(spark, d, "supplier")
    points = s.select(F.col("s_acctbal").alias("at"))
    ranges = s.select(F.col("s_suppkey").alias("suppkey"), (F.col("s_acctbal") - 100).alias("low"), (F.col("s_acctbal") + 100).alias("high"))
    return T.range_join(points, ranges, "at", "low", "high", 200.0).groupBy("suppkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE p_partkey IN (SELECT gene FROM sig)) AS found, count(*) FILTER (WHERE p_partkey NOT IN (SELECT gene FROM sig)) AS missing FROM part", VOLCANO, SIGNIFICANT)
def j12_j13_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    p, s = scored_parts(spark, d).select("gene"), significant(spark, d).select("gene")
    found, missing = p.join(s, "gene", "left_semi").agg(F.count("*").alias("found")), p.join(s, "gene", "left_anti").agg(F.count("*").alias("missing"))
    return found.crossJoin(missing)  # one row each


@query("SELECT o_orderkey AS orderkey, coalesce(a.c_mktsegment, b.c_mktsegment) AS segment FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey * 2 LEFT JOIN customer b ON b.c_custkey = o_custkey")
def j15_coalesced_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.col("o_custkey") * 2).alias("first"), F.col("o_custkey").alias("second"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return T.coalesced_lookup(o, ["first", "second"], c, "c_custkey", "segment").select("orderkey", "segment")


GRID = "grid AS (SELECT database, tissue, fold FROM (SELECT DISTINCT database FROM volcano), (SELECT DISTINCT tissue FROM volcano), (SELECT DISTINCT fold FROM volcano)), done AS (SELECT DISTINCT database, tissue, fold FROM sig WHERE fdr < 0.03)"


@query("SELECT database, tissue, CAST(bool_and(EXISTS (SELECT 1 FROM done d WHERE d.database = g.database AND d.tissue = g.tissue AND d.fold = g.fold)) AS INTEGER) AS complete, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.database = g.database AND d.tissue = g.tissue AND d.fold = g.fold)) AS to_do FROM grid g GROUP BY ALL", VOLCANO, SIGNIFICANT, GRID)
def j21_k10_completeness(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of the dimensions, which of them have results, and which are left to do."""
    v = volcano(spark, d)
    grid = v.select("database").distinct().crossJoin(v.select("tissue").distinct()).crossJoin(v.select("fold").distinct())  # a few values each
    done = significant(spark, d).filter("fdr < 0.03").select("database", "tissue", "fold").distinct()
    whole = T.completeness(grid, done, ["database", "tissue", "fold"], ["database"], "tissue")
    long = whole.unpivot(["database"], [c for c in whole.columns if c != "database"], "tissue", "complete").withColumn("tissue", F.col("tissue").cast("int"))
    left = T.to_do(grid, done, ["database", "tissue", "fold"]).groupBy("database", "tissue").agg(F.count("*").alias("to_do"))
    return long.join(left, ["database", "tissue"], "left").na.fill(0, ["to_do"]).select("database", "tissue", F.col("complete").cast("int").alias("complete"), "to_do")


@query(
    """, big AS (SELECT database, tissue, fold, method FROM volcano GROUP BY ALL HAVING count(DISTINCT gene) >= 26 AND count(DISTINCT effect) >= 14)
    SELECT database, tissue, fold, method, count(*) AS n FROM volcano SEMI JOIN big USING (database, tissue, fold, method) GROUP BY ALL""",
    VOLCANO,
)
def p18_sufficient_groups(spark: SparkSession, d: str) -> DataFrame:
    """Results of the units with enough genes and enough different effects."""
    keys = ["database", "tissue", "fold", "method"]
    return T.sufficient(volcano(spark, d), keys, "effect", "gene", 14, 26).groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS linenumber, round_even(l_quantity / 8 * 100.0, 0)::DOUBLE / 100.0 AS eighths, count(*) AS n FROM lineitem GROUP BY ALL")
def n11_half_even(spark: SparkSession, d: str) -> DataFrame:
    """Eighths rounded to two digits, where every second one is a tie."""
    x = N.half_even(F.col("l_quantity") / 8, 2)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("linenumber"), x.alias("eighths")).agg(F.count("*").alias("n"))


@query("SELECT fold, tissue, count(*) AS n, round(avg(effect), 6) AS mean, round(stddev_samp(effect), 6) AS sd, min(effect) AS low, max(effect) AS high, array_to_string(list_sort(list_distinct(list(database))), ',') AS databases FROM volcano GROUP BY ALL", VOLCANO)
def a10_cross_fold(spark: SparkSession, d: str) -> DataFrame:
    return volcano(spark, d).groupBy("fold", "tissue").agg(F.count("*").alias("n"), F.round(F.avg("effect"), 6).alias("mean"), F.round(F.stddev_samp("effect"), 6).alias("sd"), F.min("effect").alias("low"), F.max("effect").alias("high"), F.array_join(F.array_sort(F.collect_set("database")), ",").alias("databases"))


@query("SELECT gene, count(*) AS hits, count(DISTINCT tissue) AS n_tissues, count(DISTINCT method) AS n_methods, count(DISTINCT database) AS n_databases, count(DISTINCT fold) AS n_folds, min(fdr) AS min_fdr, round(avg(fdr), 9) AS mean_fdr, round(median(fdr), 9) AS median_fdr FROM sig GROUP BY gene", VOLCANO, SIGNIFICANT)
def a1_a3_gene_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(F.collect_set(c)).cast("long")
    return significant(spark, d).groupBy("gene").agg(F.count("*").alias("hits"), *(n(c).alias(f"n_{c}s") for c in ("tissue", "method", "database", "fold")), F.min("fdr").alias("min_fdr"), F.round(F.avg("fdr"), 9).alias("mean_fdr"), F.round(F.percentile("fdr", F.lit(0.5)), 9).alias("median_fdr"))


@query("SELECT max(n) AS max_hits, (SELECT count(DISTINCT tissue) FROM sig) AS n_tissues, (SELECT count(DISTINCT database) FROM sig) AS n_databases FROM (SELECT count(*) AS n FROM sig GROUP BY gene)", VOLCANO, SIGNIFICANT)
def a4_norm_constants(spark: SparkSession, d: str) -> DataFrame:
    s = significant(spark, d).groupBy("gene").agg(F.count("*").alias("n"), F.collect_set("tissue").alias("t"), F.collect_set("database").alias("b"))
    return s.agg(F.max("n").alias("max_hits"), F.size(F.array_distinct(F.flatten(F.collect_set("t")))).cast("long").alias("n_tissues"), F.size(F.array_distinct(F.flatten(F.collect_set("b")))).cast("long").alias("n_databases"))


@query("SELECT tissue, database, count(DISTINCT gene) AS n FROM sig GROUP BY ALL UNION ALL SELECT tissue, 'all', count(DISTINCT gene) FROM sig GROUP BY tissue UNION ALL SELECT NULL, 'all', count(DISTINCT gene) FROM sig", VOLCANO, SIGNIFICANT)
def a23_gene_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distinct genes by tissue and database with totals, long form."""
    genes = significant(spark, d).select("tissue", "database", "gene").distinct()
    whole = genes.rollup("tissue", "database").agg(F.count_distinct("gene").alias("n"))
    return whole.select("tissue", F.coalesce("database", F.lit("all")).alias("database"), "n")


@query("SELECT database, count(*) FILTER (WHERE tissue = 1) AS t1, count(*) FILTER (WHERE tissue = 2) AS t2, count(*) FILTER (WHERE tissue = 3) AS t3 FROM sig GROUP BY database", VOLCANO, SIGNIFICANT)
def a29_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = significant(spark, d).groupBy("database").pivot("tissue", [1, 2, 3]).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("database", *(F.col(str(i)).alias(f"t{i}") for i in (1, 2, 3)))


@query("SELECT brand, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS mean, round(coalesce(x, 0), 6) AS most, round(coalesce(s, 0), 6) AS sd FROM (SELECT DISTINCT brand FROM parts) LEFT JOIN (SELECT brand, count(*) AS n, avg(v) AS m, max(v) AS x, stddev_samp(v) AS s FROM (SELECT brand, CASE WHEN positive = 1 AND gene % 2 = 0 THEN score ELSE 0 END AS v FROM parts) WHERE v <> 0 GROUP BY brand) USING (brand)", PARTS)
def a31_nonzero_stats(spark: SparkSession, d: str) -> DataFrame:
    p = scored_parts(spark, d).withColumn("v", F.when((F.col("positive") == 1) & (F.col("gene") % 2 == 0), F.col("score")).otherwise(0.0))
    s = p.filter("v <> 0").groupBy("brand").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("most"), F.stddev_samp("v").alias("sd"))
    return T.dense_units(p, s, "brand").withColumns({c: F.round(c, 6) for c in ("mean", "most", "sd")})


@query("SELECT brand, CASE WHEN m >= 950 AND s <= 300 THEN 'consistent' WHEN s > 300 THEN 'variable' ELSE 'other' END AS band, x - m >= 150 AS has_potential FROM (SELECT brand, avg(score) AS m, stddev_samp(score) AS s, max(score) AS x FROM parts GROUP BY brand)", PARTS)
def a33_bands(spark: SparkSession, d: str) -> DataFrame:
    s = scored_parts(spark, d).groupBy("brand").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.max("score").alias("x"))
    return s.select("brand", F.when((F.col("m") >= 950) & (F.col("s") <= 300), "consistent").when(F.col("s") > 300, "variable").otherwise("other").alias("band"), (F.col("x") - F.col("m") >= 150).alias("has_potential"))


@query("SELECT n_regionkey AS grp, count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS sd FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a35_group_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of groups that a membership table defines, population deviation."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("grp"))
    return table(spark, d, "supplier").join(n, "s_nationkey").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("s_acctbal"), 6).alias("sd"))


@query("SELECT region, n FROM (SELECT count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE a AND b) AS \"a & b\", count(*) FILTER (WHERE a AND c) AS \"a & c\", count(*) FILTER (WHERE b AND c) AS \"b & c\", count(*) FILTER (WHERE a AND b AND c) AS \"a & b & c\", count(*) FILTER (WHERE a OR b) AS \"a | b\", count(*) FILTER (WHERE (a OR b) AND c) AS \"(a | b) & c\", count(*) FILTER (WHERE a OR b OR c) AS \"a | b | c\" FROM (SELECT gene, bool_or(dataset = 'training') AS a, bool_or(dataset = 'validation') AS b, bool_or(dataset = 'test') AS c FROM sig GROUP BY gene)) UNPIVOT (n FOR region IN (*))", VOLCANO, SIGNIFICANT)
def u1_overlap_table(spark: SparkSession, d: str) -> DataFrame:
    s = significant(spark, d)
    flags = U.membership("gene", a=s.filter("dataset = 'training'"), b=s.filter("dataset = 'validation'"), c=s.filter("dataset = 'test'"))
    return U.overlap_table(flags, "a", "b", "c")


@query("SELECT x, y, z, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT gene, bool_or(database = 'A') AS x, bool_or(database = 'N') AS y, bool_or(database = 'R') AS z FROM sig GROUP BY gene) JOIN parts USING (gene) GROUP BY ALL", VOLCANO, SIGNIFICANT, PARTS)
def u4_u5_regions(spark: SparkSession, d: str) -> DataFrame:
    s = significant(spark, d)
    flags = U.membership("gene", x=s.filter("database = 'A'"), y=s.filter("database = 'N'"), z=s.filter("database = 'R'")).join(scored_parts(spark, d), "gene")
    return U.regions(flags, ["x", "y", "z"], F.col("score")).withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT 'a' AS src, count(*) AS n, count(extra) AS with_extra FROM sig LEFT JOIN (SELECT NULL AS extra) ON false UNION ALL SELECT 'b', count(*), count(*) FROM known", VOLCANO, SIGNIFICANT, KNOWN)
def u2_concat(spark: SparkSession, d: str) -> DataFrame:
    both = U.concat(significant(spark, d).withColumn("src", F.lit("a")), known(spark, d).select("gene", F.lit("b").alias("src"), F.lit(1).alias("extra")))
    return both.groupBy("src").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("""SELECT a.tissue AS a, b.tissue AS b, a.n AS n_a, b.n AS n_b, coalesce(s, 0) AS shared, round(coalesce(s, 0) / (a.n + b.n - coalesce(s, 0)), 6) AS jaccard, round(coalesce(s, 0) / least(a.n, b.n), 6) AS overlap_fraction
    FROM (SELECT tissue, count(DISTINCT gene) AS n FROM sig GROUP BY 1) a JOIN (SELECT tissue, count(DISTINCT gene) AS n FROM sig GROUP BY 1) b ON a.tissue < b.tissue
    LEFT JOIN (SELECT x.tissue AS ta, y.tissue AS tb, count(DISTINCT x.gene) AS s FROM sig x JOIN sig y ON x.gene = y.gene AND x.tissue < y.tissue GROUP BY ALL) ON ta = a.tissue AND tb = b.tissue""", VOLCANO, SIGNIFICANT)
def u6_u7_jaccard(spark: SparkSession, d: str) -> DataFrame:
    j = U.pairwise_jaccard(significant(spark, d), "tissue", "gene")
    return j.withColumns({c: F.round(c, 6) for c in ("jaccard", "overlap_fraction")})


@query("SELECT gene, 5 AS n_groups FROM volcano GROUP BY gene HAVING count(DISTINCT fold) = 5", VOLCANO)
def u8_in_every_fold(spark: SparkSession, d: str) -> DataFrame:
    return U.in_every(volcano(spark, d), "fold", "gene").withColumn("n_groups", F.col("n_groups").cast("int"))


@query("SELECT gene, count(DISTINCT fold) AS n_groups, min(rank) AS best_rank, round(avg(rank), 6) AS mean_rank FROM (SELECT fold, gene, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, gene) AS rank FROM sig GROUP BY fold, gene) WHERE rank <= 50 GROUP BY gene", VOLCANO, SIGNIFICANT)
def a25_recurrent(spark: SparkSession, d: str) -> DataFrame:
    r = R.placed(significant(spark, d).groupBy("fold", "gene").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("gene")], ["fold"])
    return U.recurrent(r, "fold", "gene", "rank", 50).withColumn("mean_rank", F.round("mean_rank", 6))


@query("SELECT gene, bool_and(added) AS added FROM (SELECT gene, false AS added FROM sig UNION ALL SELECT gene, true FROM known) GROUP BY gene", VOLCANO, SIGNIFICANT, KNOWN)
def u9_expand(spark: SparkSession, d: str) -> DataFrame:
    return U.expand(significant(spark, d).select("gene").distinct(), known(spark, d), ["gene"])


DRUG_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(trim({x})), '\(.*?\)', ' ', 'g'), '\[.*?\]', ' ', 'g'), '&', ' and '), '[/,+;]', ' ', 'g'),
   '\b\d+(\.\d+)?\s*(mg|mcg|g|ml|iu|units?)\b', ' ', 'g'), '\b(""" + "|".join(X.SALT_WORDS) + r""")\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' (oral) HCl' WHEN 1 THEN ' Sodium 25 mg' WHEN 2 THEN ' & [x] Citrate/y' WHEN 3 THEN '  5.5ml;units' ELSE '' END"


@query(f"SELECT p_partkey AS partkey, {DRUG_KEY.format(x=NAME)} AS drug_key FROM part")
def f2_drug_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), X.drug_key(F.expr(NAME)).alias("drug_key"))


@query("SELECT p_partkey AS partkey, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS a, 'chr1_ENSG.2' AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'x' END AS c, upper('g' || p_partkey) || ',B' AS d, p_partkey % 2 = 0 AS e, CAST(p_partkey % 22 AS INTEGER) AS chrom FROM part")
def f1_f6_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("partkey"), X.without_ensembl_version(F.concat(F.lit("ENSG"), F.lpad(k, 5, "0"), F.lit(".7"))).alias("a"), F.concat(F.lit("chr1_"), X.without_chromosome(F.lit("chr12_ENSG.2"))).alias("b"),
        X.cleaned(F.when(F.col("p_partkey") % 3 == 0, " NaN ").otherwise(" x")).alias("c"), F.array_join(X.gene_list(F.concat(F.lit("g"), k, F.lit(" |b;;b/g"), k)), ",").alias("d"),
        X.palindromic(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "T").otherwise("G")).alias("e"), X.variant_parts(F.concat(F.lit("chr"), (F.col("p_partkey") % 22).cast("string"), F.lit("_5_A_T_b38")))["chr"].alias("chrom"),
    )


@query("SELECT p_type AS type, count(*) AS n, CASE WHEN p_type LIKE '%PROMO%' THEN 'inhibitor' WHEN p_type LIKE '%STANDARD%' THEN 'agonist' WHEN p_type LIKE '%SMALL%' THEN 'modulator' ELSE 'unknown' END AS action, CASE WHEN p_type LIKE '%PROMO%' THEN 'consistent' WHEN p_type LIKE '%STANDARD%' THEN 'inconsistent' ELSE 'unclear' END AS matched FROM part GROUP BY ALL")
def f11_actions(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("p_type").contains("PROMO"), "Kinase Blocker agonist").when(F.col("p_type").contains("STANDARD"), "partial agonist").when(F.col("p_type").contains("SMALL"), "a ligand").otherwise("None")
    t = table(spark, d, "part").withColumn("action", X.action_type(words))
    return t.groupBy(F.col("p_type").alias("type"), "action", X.direction_match(F.lit("Up"), F.col("action")).alias("matched")).agg(F.count("*").alias("n"))


@query("SELECT phase, approved, CASE WHEN approved THEN 'APPROVED' ELSE 'PHASE' || phase END AS label, CASE WHEN approved THEN 5.0::DOUBLE WHEN phase = '0' THEN 0.5 ELSE CAST(phase AS DOUBLE) END AS weight, CASE WHEN approved OR phase = '4' THEN 'Tier1_ApprovedLate' WHEN phase = '3' THEN 'Tier2_Phase3' WHEN phase IN ('1', '2') THEN 'Tier3_PhaseEarly' ELSE 'Tier4_OtherBroad' END AS tier, count(*) AS n FROM evidence GROUP BY ALL", EVIDENCE)
def f12_f13_phases(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d).groupBy("phase", "approved").agg(F.count("*").alias("n"))
    label = X.phase_label(F.col("phase"), F.col("approved"))
    return e.select("phase", "approved", label.alias("label"), X.phase_weight(F.col("phase"), F.col("approved")).alias("weight"), X.phase_tier(label).alias("tier"), "n")


@query("SELECT gene, round(-log10(greatest(min(fdr), 1e-300)), 6) AS nlp, round(1 / (1 + exp(-0.5 * (max(abs(effect)) - 2))), 9) AS sig, CASE WHEN sum(sign(effect)) > 0 THEN 'Up' WHEN sum(sign(effect)) < 0 THEN 'Down' ELSE 'Mixed' END AS direction FROM volcano GROUP BY gene", VOLCANO)
def f7_f10_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = volcano(spark, d).groupBy("gene").agg(F.min("fdr").alias("p"), F.max(F.abs("effect")).alias("e"), F.sum(F.signum("effect")).alias("s"))
    return v.select("gene", F.round(N.neg_log10(F.col("p")), 6).alias("nlp"), F.round(N.sigmoid(F.col("e")), 9).alias("sig"), N.sign_label(F.col("s")).alias("direction"))


@query("SELECT gene, count(*) AS n, round(sum(value), 4) AS total FROM expression GROUP BY gene", EXPRESSION)
def p1_long_form(spark: SparkSession, d: str) -> DataFrame:
    """A wide table of components unpivoted again."""
    wide = expression(spark, d).filter("gene < 20").groupBy("sample").pivot("gene", list(range(20))).agg(F.first("value"))
    low = T.to_long(wide, ["sample"]).withColumn("gene", F.col("gene").cast("int"))
    rest = expression(spark, d).filter("gene >= 20").select("sample", "gene", "value")
    return low.unionByName(rest).groupBy("gene").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
