"""Queries on tests, enrichment, correlation, causal joins, graphs, kernels and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.functions import pvalues as P
from evistrata.operators import causal as C
from evistrata.operators import coexpression as CX
from evistrata.operators import genotypes as GP
from evistrata.operators import graph as G
from evistrata.operators import kernels as K
from evistrata.operators import linkage as LK
from evistrata.operators import network as NW
from evistrata.operators import ranking as R
from evistrata.operators import statistics as S
from evistrata.plans.registry import query
from evistrata.plans.views import EXPRESSION, KNOWN, SIGNIFICANT, VOLCANO, expression, known, significant, table, volcano


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


WELCH = """w AS (SELECT gene, count(*) FILTER (WHERE status = 1) AS n_case, count(*) FILTER (WHERE status = 0) AS n_control, avg(value) FILTER (WHERE status = 1) AS mean_case, avg(value) FILTER (WHERE status = 0) AS mean_control,
    var_samp(value) FILTER (WHERE status = 1) AS v1, var_samp(value) FILTER (WHERE status = 0) AS v0 FROM expression GROUP BY gene),
  welch AS (SELECT *, (mean_case - mean_control) / sqrt(v1 / n_case + v0 / n_control) AS t, (v1 / n_case + v0 / n_control) ** 2 / ((v1 / n_case) ** 2 / (n_case - 1) + (v0 / n_control) ** 2 / (n_control - 1)) AS df FROM w)"""


@query("SELECT gene, n_case, n_control, round(mean_case, 6) AS mean_case, round(mean_control, 6) AS mean_control, round(mean_case - mean_control, 6) AS mean_difference, round(t, 6) AS t, round(df, 4) AS df FROM welch", EXPRESSION, WELCH)
def m3_welch(spark: SparkSession, d: str) -> DataFrame:
    w = S.welch(expression(spark, d), ["gene"], "value", "status")
    return rounded(rounded(w, 6, "mean_case", "mean_control", "mean_difference", "t"), 4, "df")


def tail_sql(density: str, z: str, steps: int = 400) -> str:
    """Two-sided tail beyond z of a symmetric density in x, by Simpson's rule from 0."""
    return f"(1 - 2 * {z} / {3 * steps} * list_sum([(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density.replace('(x)', f'({z} * i / {steps})')}) for i in range(0, {steps} + 1)]))"


T_TAIL = tail_sql("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + (x) * (x) / df, -(df + 1) / 2)", "abs(t)")
NORMAL_TAIL = tail_sql("exp(-(x) * (x) / 2) / sqrt(2 * pi())", "z")


@query(
    f""", p AS (SELECT gene, t, df, mean_case - mean_control AS diff, {T_TAIL} AS p FROM welch), r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw FROM p),
    q AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
    SELECT gene, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant_fdr, abs(diff) >= 0.1 AS high_fc, q < 0.05 AND abs(diff) >= 0.1 AS significant_combined, q < 0.05 AND diff >= 0.1 AS upregulated, q < 0.05 AND diff <= -0.1 AS downregulated FROM q""",
    EXPRESSION,
    WELCH,
)
def m3_welch_flags(spark: SparkSession, d: str) -> DataFrame:
    """With p, q and flags."""
    w = S.with_t_p(S.welch(expression(spark, d), ["gene"], "value", "status"))
    out = S.flagged(w, "p", "mean_difference", [], 0.05, 0.1)
    return rounded(rounded(out, 6, "t", "p", "q"), 4, "df").select("gene", "t", "df", "p", "q", "significant_fdr", "high_fc", "significant_combined", "upregulated", "downregulated")


@query("SELECT gene, count(*) AS n, round(regr_slope(value, status), 6) AS slope, round(regr_intercept(value, status), 6) AS intercept, round(regr_r2(value, status), 6) AS r2, round(regr_slope(value, status) / sqrt((regr_syy(value, status) - regr_slope(value, status) ** 2 * regr_sxx(value, status)) / (count(*) - 2) / regr_sxx(value, status)), 6) AS t, count(*) - 2 AS df FROM expression GROUP BY gene", EXPRESSION)
def m5_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.linear(expression(spark, d), ["gene"], "value", "status"), 6, "slope", "intercept", "r2", "t")


@query(
    """, v AS (SELECT gene, status, round(value, 1) AS value FROM expression), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, value) AS t FROM v),
    s AS (SELECT gene, count(*) FILTER (WHERE status = 1) AS n_case, count(*) FILTER (WHERE status = 0) AS n_control, sum(r) FILTER (WHERE status = 1) AS rs, sum(CAST(t AS DOUBLE) * t - 1) AS ties, median(value) FILTER (WHERE status = 1) - median(value) FILTER (WHERE status = 0) AS md FROM r GROUP BY gene),
    u AS (SELECT *, rs - n_case * (n_case + 1) / 2 AS u, n_case + n_control AS n FROM s)
    SELECT gene, n_case, n_control, CASE WHEN round(md, 6) = 0 THEN 0.0::DOUBLE ELSE round(md, 6) END AS median_difference, u, round(greatest(0, greatest(u, n_case * n_control - u) - n_case * n_control / 2 - 0.5) / sqrt(n_case * n_control / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""",
    EXPRESSION,
)
def m6_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    e = expression(spark, d).withColumn("value", F.round("value", 1))
    return rounded(S.rank_sum(e, ["gene"], "value", "status"), 6, "median_difference", "z")


@query(
    f""", v AS (SELECT gene, status, round(value, 1) AS value FROM expression), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, value) AS t FROM v),
    s AS (SELECT gene, count(*) FILTER (WHERE status = 1) AS n_case, count(*) FILTER (WHERE status = 0) AS n_control, sum(r) FILTER (WHERE status = 1) AS rs, sum(CAST(t AS DOUBLE) * t - 1) AS ties, median(value) FILTER (WHERE status = 1) - median(value) FILTER (WHERE status = 0) AS md FROM r GROUP BY gene),
    u AS (SELECT *, rs - n_case * (n_case + 1) / 2 AS u, n_case + n_control AS n FROM s), z AS (SELECT gene, u, greatest(0, greatest(u, n_case * n_control - u) - n_case * n_control / 2 - 0.5) / sqrt(n_case * n_control / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
    SELECT gene, u, round(z, 6) AS z, round({NORMAL_TAIL}, 6) AS p FROM z""",
    EXPRESSION,
)
def m6_rank_sum_p(spark: SparkSession, d: str) -> DataFrame:
    p = S.with_normal_p(S.rank_sum(expression(spark, d).withColumn("value", F.round("value", 1)), ["gene"], "value", "status"))
    return rounded(p, 6, "z", "p").select("gene", "u", "z", "p")


HYPER = "list_sum([exp(lgamma(s + 1) - lgamma(i + 1) - lgamma(s - i + 1) + lgamma(m - s + 1) - lgamma(d - i + 1) - lgamma(m - s - d + i + 1) - lgamma(m + 1) + lgamma(d + 1) + lgamma(m - d + 1)) for i in range(CAST(greatest(k, d + s - m) AS BIGINT), CAST(least(s, d) AS BIGINT) + 1)])"


@query(
    f""", u AS (SELECT count(DISTINCT gene) AS m FROM volcano), sets AS (SELECT DISTINCT fold, gene FROM sig), terms AS (SELECT p_brand AS term, p_partkey AS gene FROM part WHERE p_partkey IN (SELECT gene FROM volcano)),
    z AS (SELECT fold, term, count(*) AS k FROM sets JOIN terms USING (gene) GROUP BY ALL), x AS (SELECT fold, term, k, m, (SELECT count(*) FROM terms t WHERE t.term = z.term) AS s, (SELECT count(*) FROM sets t WHERE t.fold = z.fold) AS d FROM z, u)
    SELECT fold, term, k AS overlap, s AS term_size, d AS set_size, m AS universe, round({HYPER}, 6) AS p FROM x""",
    VOLCANO,
    SIGNIFICANT,
)
def a24_m1_over_representation(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    return rounded(S.over_representation(significant(spark, d), terms, volcano(spark, d), "fold", "term", "gene"), 6, "p")


UNIT = """units AS (SELECT DISTINCT tissue FROM volcano), uni AS (SELECT count(*) AS universe, count(*) FILTER (WHERE gene IN (SELECT gene FROM known)) AS known_in_universe FROM (SELECT DISTINCT gene FROM volcano)),
  per AS (SELECT tissue, count(DISTINCT gene) AS n_genes, count(DISTINCT CASE WHEN gene IN (SELECT gene FROM known) THEN gene END) AS n_known FROM sig GROUP BY 1),
  unit AS (SELECT u.tissue, coalesce(n_genes, 0) AS n_genes, coalesce(n_known, 0) AS n_known, universe, known_in_universe FROM units u LEFT JOIN per ON u.tissue = per.tissue, uni)"""


@query("SELECT tissue, n_genes, n_known, universe, known_in_universe, round(n_genes * known_in_universe / universe, 6) AS expected, round(CASE WHEN n_genes > 0 THEN n_known / (n_genes * known_in_universe / universe) ELSE 0 END, 6) AS fold_enrichment FROM unit", VOLCANO, SIGNIFICANT, KNOWN, UNIT)
def m32_unit_enrichment(spark: SparkSession, d: str) -> DataFrame:
    v = volcano(spark, d)
    return rounded(S.unit_enrichment(significant(spark, d), v, "tissue", "gene", known(spark, d), v), 6, "expected", "fold_enrichment")


@query(
    f""", x AS (SELECT tissue, n_known AS k, n_genes AS d, universe AS m, known_in_universe AS s FROM unit) SELECT tissue, k AS n_known, d AS n_genes, round({HYPER}, 6) AS p_exact, true AS empirical_agrees FROM x""",
    VOLCANO, SIGNIFICANT, KNOWN, UNIT,
)
def m2_empirical_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Exact tails of the unit enrichment, and whether those of 10,000 draws are within five standard errors of them."""
    v = volcano(spark, d)
    u = S.unit_enrichment(significant(spark, d), v, "tissue", "gene", known(spark, d), v)
    args = [F.col(c) for c in ("n_known", "universe", "known_in_universe", "n_genes")]
    both = u.withColumn("p_exact", P.hypergeometric_p(*args)).withColumn("p_empirical", P.empirical_hypergeometric_p(F.col("tissue"), *args))
    near = F.abs(F.col("p_empirical") - F.col("p_exact")) <= 5 * F.sqrt(F.col("p_exact") * (1 - F.col("p_exact")) / 10_000) + 2e-4
    return both.select("tissue", "n_known", "n_genes", F.round("p_exact", 6).alias("p_exact"), near.alias("empirical_agrees"))


@query(
    "SELECT database, count(*) AS n_evidence, count(*) FILTER (WHERE gene IN (SELECT gene FROM known)) AS n_known_evidence FROM (SELECT DISTINCT database, gene, tissue, method FROM sig) GROUP BY database",
    VOLCANO, SIGNIFICANT, KNOWN,
)
def a7_evidence_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return S.evidence_enrichment(significant(spark, d), "database", ["gene", "tissue", "method"], "gene", known(spark, d))


@query(
    """, g AS (SELECT tissue, gene, count(*) AS n, count(*) FILTER (WHERE effect > 0) AS up FROM sig WHERE effect <> 0 GROUP BY ALL)
    SELECT tissue, round(sum(ln(1 + n) * greatest(up, n - up) / n) / sum(ln(1 + n)), 6) AS direction_consistency FROM g GROUP BY tissue""",
    VOLCANO, SIGNIFICANT,
)
def a8_direction_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.direction_consistency(significant(spark, d), "tissue", "gene", "effect"), 6, "direction_consistency")


@query(
    """, f AS (SELECT DISTINCT database, gene FROM sig WHERE dataset <> 'test'), t AS (SELECT DISTINCT database, gene FROM sig WHERE dataset = 'test'), n AS (SELECT count(DISTINCT gene) AS m FROM volcano),
    x AS (SELECT f.database, count(*) AS n_found, count(t.gene) AS n_again, (SELECT count(*) FROM t t2 WHERE t2.database = f.database) AS n_test FROM f LEFT JOIN t USING (database, gene) GROUP BY 1)
    SELECT database, n_found, n_again, n_test, round(n_again / n_found, 6) AS rate, round(n_again / (n_found * n_test / (SELECT m FROM n)), 6) AS fold_enrichment FROM x""",
    VOLCANO, SIGNIFICANT,
)
def m31_replication(spark: SparkSession, d: str) -> DataFrame:
    s, v = significant(spark, d), volcano(spark, d)
    size = v.agg(F.count_distinct("gene")).first()[0]
    return rounded(S.replication(s.filter("dataset <> 'test'"), s.filter("dataset = 'test'"), "database", ["gene"], size), 6, "rate", "fold_enrichment")


SWEEP = [("methods_1", 1, 1, 1), ("methods_2", 2, 1, 1), ("tissues_2", 1, 2, 1), ("databases_2", 1, 1, 2), ("all_2", 2, 2, 2), ("never", 9, 9, 9)]
SWEEP_SQL = "(VALUES " + ", ".join(str(x) for x in SWEEP) + ") AS th(name, a, b, c)"


@query(
    f""", g AS (SELECT gene, count(DISTINCT method) AS m, count(DISTINCT tissue) AS t, count(DISTINCT database) AS d, gene IN (SELECT gene FROM known) AS k FROM sig GROUP BY gene), u AS (SELECT count(*) AS n, count(*) FILTER (WHERE k) AS nk FROM g),
    x AS (SELECT name, count(gene) AS n_genes, count(*) FILTER (WHERE k) AS n_known FROM {SWEEP_SQL} LEFT JOIN g ON m >= a AND t >= b AND d >= c GROUP BY name)
    SELECT name, n_genes, n_known, CAST(nk AS BIGINT) AS n_known_all, n AS universe, round(CASE WHEN n_genes > 0 THEN n_known / (n_genes * nk / n) ELSE 0 END, 6) AS fold_enrichment FROM x, u""",
    VOLCANO, SIGNIFICANT, KNOWN,
)
def m37_consensus_sweep(spark: SparkSession, d: str) -> DataFrame:
    g = significant(spark, d).groupBy("gene").agg(*(F.size(F.collect_set(c)).alias(f"n_{c}s") for c in ("method", "tissue", "database")))
    th = spark.createDataFrame(SWEEP, "name string, min_methods int, min_tissues int, min_databases int")
    return rounded(S.consensus_sweep(g, known(spark, d), "gene", th), 6, "fold_enrichment")


@query("SELECT gene, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM expression a JOIN (SELECT sample - 1 AS sample, gene, value FROM expression) b USING (gene, sample) GROUP BY gene HAVING count(*) >= 3", EXPRESSION)
def m13_gene_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Each gene's values against those of the next sample."""
    e = expression(spark, d)
    return rounded(S.gene_correlations(e, e.withColumn("sample", F.col("sample") - 1), ["gene"], "sample"), 6, "r")


@query(
    """, r AS (SELECT batch, gene, corr(value, sample) AS r FROM expression GROUP BY ALL), t AS (SELECT gene % 4 AS grp, batch, avg(r) AS r FROM r GROUP BY ALL)
    SELECT grp, round(avg(r), 6) AS r, count(*) AS n_items FROM t GROUP BY grp""",
    EXPRESSION,
)
def m13_mean_pyramid(spark: SparkSession, d: str) -> DataFrame:
    r = expression(spark, d).groupBy("batch", "gene").agg(F.corr("value", "sample").alias("r")).withColumn("grp", F.col("gene") % 4)
    return rounded(S.mean_pyramid(r, [["grp", "batch"], ["grp"]]), 6, "r")


@query("SELECT gene, count(*) AS n, round(avg(abs(d)), 6) AS mean_abs, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS mean_change, round(corr(value, v2), 6) AS r FROM (SELECT *, value * 0.9 + status * 0.05 AS v2, value * 0.9 + status * 0.05 - value AS d FROM expression) GROUP BY gene", EXPRESSION)
def m15_change_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = expression(spark, d)
    return rounded(S.change_metrics(e, e.withColumn("value", F.col("value") * 0.9 + F.col("status") * 0.05), ["gene", "sample"], ["gene"]), 6, "mean_abs", "rmse", "mean_change", "r")


@query(
    """, a AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part)
    SELECT 'p_size' AS x, 'p_retailprice' AS y, count(*) AS n, round(corr(a.x, a.y), 6) AS rho FROM a""".replace(", a AS", "WITH a AS", 1)
)
def m36_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.spearman(table(spark, d, "part"), [("p_size", "p_retailprice")]), 6, "rho")


GENETIC = """g AS (SELECT CAST(l_linenumber AS INTEGER) AS chr, CAST(l_partkey AS INTEGER) AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'G' END AS ref, CASE l_linestatus WHEN 'F' THEN 'T' ELSE 'A' END AS alt, l_discount - 0.05 AS eqtl_beta, l_quantity / 500 AS eqtl_se, l_suppkey AS gene FROM lineitem),
  w AS (SELECT CAST(p_size % 7 + 1 AS INTEGER) AS chr, CAST(p_partkey AS INTEGER) AS pos, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'C' END AS a1, CASE WHEN p_size % 3 = 0 THEN 'T' ELSE 'A' END AS a2, (p_retailprice - 1000) / 5000 AS gwas_beta, p_size / 100 AS gwas_se FROM part),
  h AS (SELECT *, CASE WHEN a1 = alt AND a2 = ref THEN -eqtl_beta ELSE eqtl_beta END AS b FROM g JOIN w USING (chr, pos) WHERE (a1 = ref AND a2 = alt) OR (a1 = alt AND a2 = ref))"""


def genetic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    g = li.select(
        F.col("l_linenumber").cast("int").alias("chr"), F.col("l_partkey").cast("int").alias("pos"), F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "C").otherwise("G").alias("ref"),
        F.when(F.col("l_linestatus") == "F", "T").otherwise("A").alias("alt"), (F.col("l_discount") - 0.05).alias("eqtl_beta"), (F.col("l_quantity") / 500).alias("eqtl_se"), F.col("l_suppkey").alias("gene"),
    )
    w = p.select(
        (F.col("p_size") % 7 + 1).cast("int").alias("chr"), F.col("p_partkey").cast("int").alias("pos"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("C").alias("a1"), F.when(F.col("p_size") % 3 == 0, "T").otherwise("A").alias("a2"),
        ((F.col("p_retailprice") - 1000) / 5000).alias("gwas_beta"), (F.col("p_size") / 100).alias("gwas_se"),
    )
    return g, w


@query(
    "SELECT gene, chr, pos, CASE WHEN round(b, 6) = 0 THEN 0.0::DOUBLE ELSE round(b, 6) END AS eqtl_beta_aligned, round(CASE WHEN abs(b) >= 1e-12 THEN gwas_beta / b END, 4) AS mr_beta, round(CASE WHEN abs(b) >= 1e-12 THEN abs(gwas_beta / b) / sqrt(gwas_se ** 2 / b ** 2 + gwas_beta ** 2 * eqtl_se ** 2 / b ** 4) END, 4) AS mr_abs_z, round(eqtl_se, 6) AS eqtl_se FROM h",
    GENETIC,
)
def j9_m39_wald_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = C.wald_ratio(C.harmonised(*genetic(spark, d)))
    return out.select("gene", "chr", "pos", F.round("eqtl_beta_aligned", 6).alias("eqtl_beta_aligned"), F.round("mr_beta", 4).alias("mr_beta"), F.round(F.abs("mr_z"), 4).alias("mr_abs_z"), F.round("eqtl_se", 6).alias("eqtl_se"))


@query(
    """, x AS (SELECT chr, pos, eqtl_beta AS b1, eqtl_se AS s1, gwas_beta AS b2, gwas_se AS s2 FROM g JOIN w USING (chr, pos)),
    l AS (SELECT chr, 0.5 * (ln(1 - 0.0225 / (0.0225 + s1 ** 2)) + 0.0225 / (0.0225 + s1 ** 2) * (b1 / s1) ** 2) AS l1, 0.5 * (ln(1 - 0.04 / (0.04 + s2 ** 2)) + 0.04 / (0.04 + s2 ** 2) * (b2 / s2) ** 2) AS l2 FROM x WHERE s1 > 0 AND s2 > 0),
    s AS (SELECT chr, count(*) AS n, ln(sum(exp(l1))) AS a, ln(sum(exp(l2))) AS b, ln(sum(exp(l1 + l2))) AS c FROM l GROUP BY chr HAVING count(*) >= 20),
    h5 AS (SELECT chr, n, 0.0 AS h0, ln(1e-4) + a AS h1, ln(1e-4) + b AS h2, 2 * ln(1e-4) + a + b + ln(1 - exp(c - a - b)) AS h3, ln(1e-5) + c AS h4 FROM s)
    SELECT chr, n, round(exp(h0) / (exp(h0) + exp(h1) + exp(h2) + exp(h3) + exp(h4)), 6) AS pp_h0, round(exp(h1) / (exp(h0) + exp(h1) + exp(h2) + exp(h3) + exp(h4)), 6) AS pp_h1, round(exp(h2) / (exp(h0) + exp(h1) + exp(h2) + exp(h3) + exp(h4)), 6) AS pp_h2,
       round(exp(h3) / (exp(h0) + exp(h1) + exp(h2) + exp(h3) + exp(h4)), 6) AS pp_h3, round(exp(h4) / (exp(h0) + exp(h1) + exp(h2) + exp(h3) + exp(h4)), 6) AS pp_h4 FROM h5""",
    GENETIC,
)
def m40_colocalisation(spark: SparkSession, d: str) -> DataFrame:
    g, w = genetic(spark, d)
    x = g.join(w, ["chr", "pos"]).select("chr", F.col("eqtl_beta").alias("beta_1"), F.col("eqtl_se").alias("se_1"), F.col("gwas_beta").alias("beta_2"), F.col("gwas_se").alias("se_2"))
    return rounded(C.colocalised(x, ["chr"]), 6, *(f"pp_h{i}" for i in range(5)))


@query(
    """, b AS (SELECT gene, chr, pos, eqtl_beta, eqtl_se, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN l = 1 THEN eqtl_se END NULLS LAST, abs(eqtl_beta / eqtl_se) DESC, chr, pos) AS n FROM (SELECT *, pos % 2 AS l FROM g))
    SELECT gene, chr, pos FROM b WHERE n = 1""",
    GENETIC,
)
def w7_best_instrument(spark: SparkSession, d: str) -> DataFrame:
    g = genetic(spark, d)[0].withColumn("p", F.when(F.col("pos") % 2 == 1, F.col("eqtl_se"))).withColumn("z", F.col("eqtl_beta") / F.col("eqtl_se"))
    return C.best_instrument(g, ["gene"]).select("gene", "chr", "pos")


@query("SELECT l_suppkey AS sample, p_brand AS gene, round(sum(CASE WHEN p_size % 2 = 0 THEN l_linenumber % 3 ELSE 2 - l_linenumber % 3 END * p_size / 50), 6) AS score, count(*) AS n_snps FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 > 0 GROUP BY ALL")
def m41_genotype_scores(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("snp"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), (F.col("l_linenumber") % 3).cast("double").alias("dosage"))
    w = table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("snp"), F.when(F.col("p_size") % 5 == 0, "G").when(F.col("p_size") % 2 == 0, "T").otherwise("A").alias("allele"), (F.col("p_size") / 50).alias("weight"))
    return rounded(C.genotype_scores(g, w), 6, "score")


@query(
    """SELECT sample, p_brand AS gene, round(sum(CASE WHEN p_size % 2 = 0 THEN dosage ELSE 2 - dosage END * p_size / 50), 6) AS score, count(*) AS n_snps
    FROM calls JOIN part ON snp = p_partkey WHERE p_size % 5 > 0 AND NOT missing GROUP BY ALL""",
    "calls AS (SELECT l_suppkey AS sample, l_partkey AS snp, min(l_linenumber) % 3 AS dosage, min(l_linenumber) % 7 = 3 AS missing FROM lineitem GROUP BY ALL)",
)
def m41_packed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Calls of two bits, weights met once a variant, and scores as products over blocks of samples."""
    calls = table(spark, d, "lineitem")
    first = calls.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("snp")).agg(F.min("l_linenumber").alias("m"))
    g = first.select("sample", "snp", F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.when(F.col("m") % 7 != 3, F.col("m") % 3).alias("dosage"))
    w = table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("snp"), F.when(F.col("p_size") % 5 == 0, "G").when(F.col("p_size") % 2 == 0, "T").otherwise("A").alias("allele"), (F.col("p_size") / 50).alias("weight"))
    samples = GP.sample_index(calls.select(F.col("l_suppkey").alias("sample")))
    return rounded(GP.packed_scores(GP.pack(g, samples), w, samples), 6, "score")


EDGES = "edges AS (SELECT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v, max(l_quantity / 50) AS w FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity / 50 >= 0.98 GROUP BY ALL)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_quantity") / 50).alias("weight"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return G.induced(e, nodes, 0.98)


@query("SELECT u, v, round(w, 6) AS w FROM edges", EDGES)
def g1_induced_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edges(spark, d), 6, "w")


@query(
    """, RECURSIVE_ AS (SELECT 1), both_ AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), reach AS (SELECT u AS node, u AS r FROM both_ UNION SELECT reach.node, b.v FROM reach JOIN both_ b ON reach.r = b.u)
    SELECT node, min(r) AS component FROM reach GROUP BY node""".replace("RECURSIVE_ AS (SELECT 1), ", ""),
    EDGES.replace("edges AS", "RECURSIVE edges AS", 1),
)
def g2_components(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.connected_components(e, "u", "v")


@query("SELECT node, count(*) AS degree, round(sum(abs(w)), 6) AS strength FROM (SELECT u AS node, w FROM edges UNION ALL SELECT v, w FROM edges) GROUP BY node", EDGES)
def g3_strengths(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.strengths(edges(spark, d)), 6, "strength")


@query(
    """, arcs AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), nodes AS (SELECT DISTINCT u AS node FROM arcs),
    reach AS (SELECT node AS s, node AS t, 0 AS d FROM nodes UNION SELECT s, v, d + 1 FROM reach JOIN arcs ON t = u WHERE d < 14),
    far AS (SELECT s, t, min(d) AS d FROM reach GROUP BY s, t)
    SELECT s AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM nodes) - 1) ELSE 0 END, 9) AS closeness FROM far GROUP BY s""",
    EDGES.replace("edges AS", "RECURSIVE edges AS", 1),
)
def g4_closeness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(NW.centralities(edges(spark, d), k=1).select("node", "closeness"), 9, "closeness")


@query()
def g4_hub_scores(spark: SparkSession, d: str) -> DataFrame:
    """Degree, sampled betweenness, closeness and PageRank, weighted .35, .15, .25 and .25, and the hub class; tested on known graphs."""
    e = edges(spark, d)
    s = G.strengths(e)
    top = s.agg((F.count("*") - 1).alias("others"))
    joined = s.join(NW.centralities(e, k=0), "node").join(G.pagerank(e, s), "node").crossJoin(F.broadcast(top))  # one row
    score = 0.35 * F.col("degree") / F.col("others") + 0.15 * F.col("betweenness") + 0.25 * F.col("closeness") + 0.25 * F.col("pagerank")
    return R.rank_class(R.ranked(joined.withColumn("hub_score", score), [F.round("hub_score", 9).desc(), F.asc("node")]), "rank", 10).drop("others")


@query()
def g5_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the whole network, by all trials and until no move gains; tested against greedy merging on random graphs."""
    return NW.communities(edges(spark, d))


@query()
def l9_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    """The merge tree of the genes of each tissue by correlation distance; tested against one merge after another."""
    r = CX.pair_correlations(gapped(spark, d), ["tissue"], tile_genes=24)
    return LK.average_linkage(r.withColumn("distance", 1 - F.round("r", 9)), ["tissue"], "u", "v")


@query(
    """, m AS (SELECT DISTINCT fold, tissue, gene FROM sig), n AS (SELECT fold, tissue, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT a.fold AS fa, a.tissue AS ta, b.fold AS fb, b.tissue AS tb, count(*) AS s FROM m a JOIN m b ON a.gene = b.gene AND a.fold <> b.fold GROUP BY ALL),
    j AS (SELECT fa, ta, fb, max(s / (x.n + y.n - s)) AS j FROM s JOIN n x ON x.fold = fa AND x.tissue = ta JOIN n y ON y.fold = fb AND y.tissue = tb GROUP BY ALL)
    SELECT n.fold, n.tissue, round(coalesce(sum(j), 0) / greatest(1, (SELECT count(DISTINCT fold) - 1 FROM m)), 9) AS preservation FROM n LEFT JOIN j ON fa = n.fold AND ta = n.tissue GROUP BY n.fold, n.tissue""",
    VOLCANO, SIGNIFICANT,
)
def g6_module_preservation(spark: SparkSession, d: str) -> DataFrame:
    mods = significant(spark, d).select("fold", "tissue", "gene").distinct()
    return rounded(G.preservation(mods, "fold", "tissue", "gene"), 9, "preservation")


@query()
def m4_moderated_t(spark: SparkSession, d: str) -> DataFrame:
    return K.moderated_t(expression(spark, d).withColumn("grp", F.lit("all")), ["grp"])


@query()
def m7_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return K.permutation_test(expression(spark, d).withColumn("grp", F.lit("all")), ["grp"])


@query()
def m8_weighted_logistic(spark: SparkSession, d: str) -> DataFrame:
    return K.logistic(expression(spark, d).withColumn("grp", F.lit("all")), ["grp"], "weighted")


@query()
def m9_firth_logistic(spark: SparkSession, d: str) -> DataFrame:
    return K.logistic(expression(spark, d).withColumn("grp", F.lit("all")), ["grp"], "firth")


@query()
def m10_bayes_logistic(spark: SparkSession, d: str) -> DataFrame:
    return K.logistic(expression(spark, d).withColumn("grp", F.lit("all")), ["grp"], "bayes")


@query(
    """, c AS (SELECT gene, sample, value AS y, CAST(batch AS DOUBLE) AS c1, CAST(sample % 7 AS DOUBLE) AS c2 FROM expression),
    a AS (SELECT gene, regr_slope(c2, c1) AS k, avg(c1) AS m1, avg(c2) AS m2, avg(y) AS m, regr_slope(y, c1) AS b FROM c GROUP BY gene),
    e AS (SELECT gene, sample, c2 - m2 - k * (c1 - m1) AS e2, y - m - b * (c1 - m1) AS ey, m FROM c JOIN a USING (gene)), f AS (SELECT gene, regr_slope(ey, e2) AS b2 FROM e GROUP BY gene)
    SELECT gene, sample, round(ey - b2 * e2 + m, 6) + 0.0 AS value FROM e JOIN f USING (gene)""",
    EXPRESSION,
)
def m12_residualised(spark: SparkSession, d: str) -> DataFrame:
    """Two covariates taken out; the SQL takes out one, and then what it leaves of the other."""
    e = expression(spark, d).withColumn("grp", F.lit("all"))
    cov = e.select("sample", F.col("batch").cast("double").alias("c1"), (F.col("sample") % 7).cast("double").alias("c2")).distinct()
    return K.residualised(e, cov, ["grp"], ["c1", "c2"]).select("gene", "sample", (F.round("value", 6) + 0.0).alias("value"))


def gapped(spark: SparkSession, d: str) -> DataFrame:
    """Expression with gaps, in three groups of samples."""
    value = F.when((F.col("sample") * 7 + F.col("gene") * 13) % 11 != 0, F.col("value"))
    return expression(spark, d).select(F.concat(F.lit("t"), (F.col("batch") % 3).cast("string")).alias("tissue"), "gene", "sample", value.alias("value"))


GAPPED = "gapped AS (SELECT 't' || CAST(batch % 3 AS VARCHAR) AS tissue, gene, sample, CASE WHEN (sample * 7 + gene * 13) % 11 <> 0 THEN value END AS value FROM expression)"


@query(
    """SELECT a.tissue, a.gene AS u, b.gene AS v, round(corr(a.value, b.value), 6) + 0.0 AS r, count(*) AS n FROM gapped a JOIN gapped b ON a.tissue = b.tissue AND a.sample = b.sample AND a.gene < b.gene
    WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL HAVING count(*) >= 20""",
    EXPRESSION, GAPPED,
)
def m16_pair_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise-complete correlation of every two genes of a tissue, in tiles."""
    return CX.pair_correlations(gapped(spark, d), ["tissue"], tile_genes=24).select("tissue", "u", "v", (F.round("r", 6) + 0.0).alias("r"), "n")


@query()
def m16_m18_coexpression(spark: SparkSession, d: str) -> DataFrame:
    """Edges beyond the null of each tissue that resampling keeps, without pairs of shared predictors; tested against pandas."""
    predictors = table(spark, d, "part").select((F.col("p_partkey") % 64).cast("int").alias("gene"), F.concat("p_brand", F.col("p_size")).alias("snp"))
    return CX.coexpression(gapped(spark, d), ["tissue"], predictors=predictors, tile_genes=24)


@query()
def l1_l8_models(spark: SparkSession, d: str) -> DataFrame:
    """Selection, grid search and scores of three model families per split; tested on separable data."""
    from evistrata.operators.ml import train_and_score

    e = expression(spark, d)
    wide = e.groupBy("sample", "status").pivot("gene", list(range(64))).agg(F.first("value"))
    named = wide.select("sample", F.col("status").cast("double").alias("label"), *(F.col(str(i)).alias(f"g{i}") for i in range(64)))
    part = F.pmod(F.xxhash64("sample"), F.lit(5))
    split = F.when(part < 3, "train").when(part == 3, "validation").otherwise("test")
    return train_and_score(named.withColumn("split", split), [f"g{i}" for i in range(64)], n_features=10)
