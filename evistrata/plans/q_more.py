"""Queries on roll-ups by unit, pair, panel and fold, and on permutations and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.operators import permutation as M
from evistrata.operators import ranking as R
from evistrata.operators import rollups as A
from evistrata.plans.q_stats import HYPER, rounded
from evistrata.plans.registry import query
from evistrata.plans.views import EVIDENCE, EXPRESSION, KNOWN, PARTS, SIGNIFICANT, VOLCANO, evidence, expression, known, scored_parts, significant, table, volcano

REFERENCE = "ref AS (SELECT s_suppkey AS drug FROM supplier WHERE s_acctbal > 5000)"
RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM parts)"


def reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("drug"))


def ranked_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(scored_parts(spark, d), [F.desc("score"), F.asc("gene")])


@query("SELECT o_orderkey AS sample, o_totalprice AS value, c_custkey AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def j2_sample_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of samples that an ordering table has, with their place."""
    order = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("place"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("key"))
    return A.in_order_of(rows, order, "key", "place").select("sample", "value", "place")


@query(
    """SELECT l_partkey AS sample, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R
    FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'N') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0"""
)
def j3_chromosome_merge(spark: SparkSession, d: str) -> DataFrame:
    """Samples (parts) that every chromosome (flag) has, a column each."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sample"), F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("value"))
    return A.in_all_parts(rows, "part", "sample", "value", ["A", "N", "R"])


@query(
    """SELECT CASE WHEN lower(trim(p_name)) IN ('', 'nan', 'none', 'true', 'false') THEN 'chr' || p_size || '_unknown' ELSE 'chr' || p_size || '_' || trim(p_name) END AS gene, sample, value FROM (
      SELECT CASE WHEN p_partkey % 7 = 0 THEN 'True' WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS p_name, p_size, s.sample, CASE s.sample WHEN 's1' THEN p_retailprice ELSE p_retailprice / 2 END AS value FROM part, (SELECT unnest(['s1', 's2']) AS sample) s)"""
)
def p2_repaired_transpose(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, "True").when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name"))
    wide = table(spark, d, "part").select(name.alias("target"), F.col("p_size").alias("chrom"), F.col("p_retailprice").alias("s1"), (F.col("p_retailprice") / 2).alias("s2"))
    return A.repaired_transpose(wide, "target", "chrom", [])


@query("SELECT upper(trim(p_brand)) AS symbol, list_sort(list(DISTINCT p_partkey)) AS ids, CAST(count(DISTINCT p_partkey) AS INTEGER) AS n FROM part GROUP BY 1")
def j14_symbol_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.symbol_sets(table(spark, d, "part"), "p_brand", "p_partkey")


FOLD_GENES = "fold_genes AS (SELECT fold, gene, count(*) AS weight, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, gene) AS rank FROM sig GROUP BY fold, gene)"


@query("SELECT fold, drug, CAST(sum(weight) AS BIGINT) AS drug_score, count(*) AS n_genes, min(rank) AS best_rank FROM fold_genes JOIN (SELECT DISTINCT gene, drug FROM evidence) USING (gene) GROUP BY fold, drug", VOLCANO, SIGNIFICANT, EVIDENCE, FOLD_GENES)
def j17_fold_drugs(spark: SparkSession, d: str) -> DataFrame:
    per = significant(spark, d).groupBy("fold", "gene").agg(F.count("*").alias("weight"))
    return A.fold_drugs(R.placed(per, [F.desc("weight"), F.asc("gene")], ["fold"]), evidence(spark, d), "fold", "gene", "rank", "weight", "drug")


@query("SELECT gene % 50 AS disease, count(DISTINCT drug) AS n_hits, string_agg(DISTINCT CAST(drug AS VARCHAR), '|' ORDER BY CAST(drug AS VARCHAR)) AS hits FROM evidence SEMI JOIN ref USING (drug) GROUP BY 1", EVIDENCE, REFERENCE)
def j18_disease_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped_hits(evidence(spark, d).withColumn("disease", F.col("gene") % 50), reference(spark, d), "drug", "disease")


@query(
    f""", mods AS (SELECT DISTINCT gene % 20 AS module, gene FROM sig), terms AS (SELECT DISTINCT drug AS pathway, gene FROM evidence), u AS (SELECT count(*) AS m FROM parts),
    z AS (SELECT module, pathway, count(*) AS k FROM mods JOIN terms USING (gene) GROUP BY ALL HAVING count(*) >= 2), x AS (SELECT module, pathway, k, m, (SELECT count(*) FROM terms t WHERE t.pathway = z.pathway) AS s, (SELECT count(*) FROM mods t WHERE t.module = z.module) AS d FROM z, u)
    SELECT module, pathway, k AS overlap, d AS set_size, s AS term_size, m AS universe, round({HYPER}, 6) AS p FROM x""",
    VOLCANO, SIGNIFICANT, EVIDENCE, PARTS,
)
def j20_module_pathways(spark: SparkSession, d: str) -> DataFrame:
    """Modules and pathways with two common genes or more, joined on the gene."""
    from evistrata.operators.statistics import over_representation

    modules = significant(spark, d).select((F.col("gene") % 20).alias("module"), "gene")
    terms = evidence(spark, d).select(F.col("drug").alias("pathway"), "gene")
    return rounded(over_representation(modules, terms, scored_parts(spark, d), "module", "pathway", "gene", least=2), 6, "p")


@query(
    """, r AS (SELECT gene, fdr AS quality, tissue, row_number() OVER (PARTITION BY gene ORDER BY fdr, tissue, effect) AS place FROM volcano WHERE database = 'R')
    SELECT p.gene, p.score, quality, tissue, quality IS NOT NULL AS has_result FROM parts p LEFT JOIN (SELECT * FROM r WHERE place = 1) r ON p.gene = r.gene""",
    PARTS, VOLCANO,
)
def j22_merged_back(spark: SparkSession, d: str) -> DataFrame:
    """Structure results beside every gene, the best of several."""
    results = volcano(spark, d).filter("database = 'R'").select("gene", F.col("fdr").alias("quality"), "tissue", "effect")
    return A.merged_back(scored_parts(spark, d).select("gene", "score"), results, ["gene"], [F.asc("quality"), F.asc("tissue"), F.asc("effect")]).drop("effect")


@query("SELECT tissue, count(DISTINCT gene) AS n_genes, count(DISTINCT CASE WHEN gene IN (SELECT gene FROM known) THEN gene END) AS n_known, count(DISTINCT gene) FILTER (WHERE effect > 0) AS n_up FROM sig GROUP BY tissue", VOLCANO, SIGNIFICANT, KNOWN)
def a6_conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    marked = significant(spark, d).join(known(spark, d).withColumn("k", F.lit(True)), "gene", "left")
    return marked.groupBy("tissue").agg(F.count_distinct("gene").alias("n_genes"), F.count_distinct(F.when(F.col("k"), F.col("gene"))).alias("n_known"), F.count_distinct(F.when(F.col("effect") > 0, F.col("gene"))).alias("n_up"))


@query(
    """, u AS (SELECT DISTINCT database, CAST(gene AS VARCHAR) AS g, gene IN (SELECT gene FROM known) AS k FROM sig)
    SELECT database, count(*) AS n_items, count(*) FILTER (WHERE k) AS n_known, coalesce(string_agg(g, '|' ORDER BY g) FILTER (WHERE k), '') AS known_items FROM u GROUP BY database""",
    VOLCANO, SIGNIFICANT, KNOWN,
)
def a9_unit_sets(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("gene").cast("string")
    return A.unit_sets(significant(spark, d).withColumn("gene", text), "database", "gene", known(spark, d).withColumn("gene", text))


@query(
    """, e AS (SELECT e.*, row_number() OVER (PARTITION BY gene ORDER BY phase, drug, source) AS place FROM (SELECT DISTINCT gene, drug, source, phase FROM evidence) e)
    SELECT r.gene, rank, score, coalesce(count(source), 0) AS n_rows, coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') AS labels, arg_min(source, place) AS first_label FROM ranked r LEFT JOIN e USING (gene) WHERE rank <= 20 GROUP BY ALL""",
    EVIDENCE, PARTS, RANKED,
)
def a13_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = R.ranked(evidence(spark, d).select("gene", "drug", "source", "phase").distinct(), [F.asc("phase"), F.asc("drug"), F.asc("source")], ["gene"], "place")
    return A.panel(ranked_parts(spark, d).select("gene", "rank", "score"), rows, "gene", "rank", "source", 20)


@query(
    """, e AS (SELECT gene % 100 AS gene, drug, CASE WHEN phase = '0' THEN ' ' ELSE phase END AS phase, gene AS number, source FROM evidence), f AS (SELECT *, nullif(trim(phase), '') AS t FROM e)
    SELECT gene, drug, (SELECT t FROM f g WHERE g.gene = f.gene AND g.drug = f.drug AND t IS NOT NULL ORDER BY number, t LIMIT 1) AS first_text, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS texts, min(number) AS low, max(number) AS high, count(*) AS n FROM f GROUP BY gene, drug""",
    EVIDENCE,
)
def a15_pair_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d).select((F.col("gene") % 100).alias("gene"), "drug", F.when(F.col("phase") == "0", " ").otherwise(F.col("phase")).alias("phase"), F.col("gene").alias("number"))
    return A.pair_rollup(e, ["gene", "drug"], "phase", "number", "number")


@query("SELECT p.gene, coalesce(max(-log10(fdr)), 0) AS evidence, coalesce(max(abs(effect)), 0) AS druggability FROM (SELECT gene FROM parts) p LEFT JOIN sig ON p.gene = sig.gene GROUP BY p.gene", VOLCANO, SIGNIFICANT, PARTS)
def a16_max_per_gene(spark: SparkSession, d: str) -> DataFrame:
    from evistrata.operators.tables import evidence_chain

    s = significant(spark, d).select("gene", (-F.log10("fdr")).alias("evidence"), F.abs("effect").alias("druggability"))
    return evidence_chain(scored_parts(spark, d).select("gene"), "gene", (s, ["evidence", "druggability"]))


@query(
    """, f AS (SELECT gene, method, tissue, fold, row_number() OVER (PARTITION BY method, tissue, fold ORDER BY count(*) DESC, gene) AS rank FROM sig GROUP BY gene, method, tissue, fold),
    c AS (SELECT gene, method, tissue, count(*) AS folds, avg(rank) AS avg_rank FROM f WHERE rank <= 50 GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (PARTITION BY method, tissue ORDER BY folds DESC, avg_rank, gene) AS place FROM c), t AS (SELECT * FROM h WHERE place <= 30)
    SELECT gene, count(DISTINCT method) AS n_methods, count(DISTINCT tissue) AS n_tissues, CAST(sum(folds) AS BIGINT) AS appearances, round(avg(avg_rank), 6) AS avg_rank,
       round(2.0 * count(DISTINCT method) + 1.5 * count(DISTINCT tissue) + 0.5 * sum(folds) + 0.1 * (50 - least(avg(avg_rank), 50)), 6)::DOUBLE AS consistency FROM t GROUP BY gene""",
    VOLCANO, SIGNIFICANT,
)
def a27_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """Hubs that several folds share, the first thirty of each method and tissue, over methods and tissues."""
    per = significant(spark, d).groupBy("gene", "method", "tissue", "fold").agg(F.count("*").alias("n"))
    first = R.ranked(per, [F.desc("n"), F.asc("gene")], ["method", "tissue", "fold"]).filter("rank <= 50")
    shared = first.groupBy("gene", "method", "tissue").agg(F.count("*").alias("folds"), F.avg("rank").alias("avg_rank"))
    return rounded(A.recurrence(shared, "gene", "method", "tissue", "folds", "avg_rank"), 6, "avg_rank", "consistency")


@query(
    """SELECT database, tissue, count(*) AS n_seen, count(DISTINCT tissue) AS n_tissues, count(DISTINCT method) AS n_methods FROM sig GROUP BY ALL""",
    VOLCANO, SIGNIFICANT,
)
def a27_term_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """How often a term (here a database and its tissue) recurs, in how many tissues and by how many methods."""
    return A.term_recurrence(significant(spark, d), ["database", "tissue"], "method", "tissue")


@query(
    """, n AS (SELECT tissue, method, count(*) / 100.0 AS density, avg(abs(effect)) AS strength FROM sig GROUP BY ALL)
    SELECT tissue, round(avg(density), 6)::DOUBLE AS mean_density, round(stddev_pop(density), 6)::DOUBLE AS std_density, round(avg(strength), 6) AS mean_strength, round(stddev_pop(strength), 6) AS std_strength, count(*) AS n_methods FROM n GROUP BY tissue""",
    VOLCANO, SIGNIFICANT,
)
def a27_tissue_stability(spark: SparkSession, d: str) -> DataFrame:
    """Spread over methods of each tissue's network figures."""
    n = significant(spark, d).groupBy("tissue", "method").agg((F.count("*") / 100.0).alias("density"), F.avg(F.abs("effect")).alias("strength"))
    return rounded(A.spread_over(n, "tissue", "method", ["density", "strength"]), 6, "mean_density", "std_density", "mean_strength", "std_strength")


@query("SELECT tissue, method, round(value, 9) AS value FROM (SELECT tissue, method, avg(effect) AS value FROM volcano GROUP BY ALL) ORDER BY round(value, 9) DESC, tissue, method LIMIT 10", VOLCANO)
def a32_top_cells(spark: SparkSession, d: str) -> DataFrame:
    wide = volcano(spark, d).groupBy("tissue").pivot("method", ["F", "O"]).agg(F.round(F.avg("effect"), 9))
    return A.top_cells(wide, "tissue", "method", "value", 10)


@query(
    """, own AS (SELECT DISTINCT tissue, database, gene FROM sig), there AS (SELECT DISTINCT tissue, database FROM own), pairs AS (SELECT a.tissue, a.database AS a, b.database AS b FROM there a JOIN there b ON a.tissue = b.tissue AND a.database < b.database),
    c AS (SELECT p.*, (SELECT count(*) FROM own x JOIN own y ON x.gene = y.gene AND x.tissue = y.tissue WHERE x.tissue = p.tissue AND x.database = p.a AND y.database = p.b) AS common FROM pairs p)
    SELECT a, b, round(avg(common), 6) AS mean_common, count(*) AS n FROM c GROUP BY a, b""",
    VOLCANO, SIGNIFICANT,
)
def a37_common_per_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.common_per_pair(significant(spark, d), "tissue", "database", "gene"), 6, "mean_common")


@query(
    """, m AS (SELECT DISTINCT drug, gene % 50 AS disease FROM evidence), n AS (SELECT count(DISTINCT drug) AS all_drugs, count(DISTINCT CASE WHEN drug IN (SELECT drug FROM ref) THEN drug END) AS chosen FROM m)
    SELECT disease, count(*) AS K, count(*) FILTER (WHERE drug IN (SELECT drug FROM ref)) AS x, round(count(*) * max(chosen) / max(all_drugs), 6) AS expected, round(count(*) FILTER (WHERE drug IN (SELECT drug FROM ref)) / (count(*) * max(chosen) / max(all_drugs)), 6) AS fold_enrichment FROM m, n GROUP BY disease""",
    EVIDENCE, REFERENCE,
)
def a21_disease_counts(spark: SparkSession, d: str) -> DataFrame:
    m = evidence(spark, d).select("drug", (F.col("gene") % 50).alias("disease")).distinct().join(reference(spark, d).withColumn("hit", F.lit(1)), "drug", "left")
    totals = m.agg(F.count_distinct("drug").alias("all_drugs"), F.count_distinct(F.when(F.col("hit") == 1, F.col("drug"))).alias("chosen"))
    per = m.groupBy("disease").agg(F.count("*").alias("K"), F.count("hit").alias("x")).crossJoin(F.broadcast(totals))  # one row
    expected = F.col("K") * F.col("chosen") / F.col("all_drugs")
    return per.select("disease", "K", "x", F.round(expected, 6).alias("expected"), F.round(F.col("x") / expected, 6).alias("fold_enrichment"))


MERGED = """s AS (SELECT tissue, method, fold, avg(effect) AS auc FROM volcano GROUP BY ALL),
  merged AS (SELECT tissue, method, avg(auc) AS mean, stddev_samp(auc) AS sd, count(DISTINCT fold) AS n_folds, string_agg(DISTINCT CAST(fold AS VARCHAR), '|' ORDER BY CAST(fold AS VARCHAR)) AS folds FROM s GROUP BY ALL)"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    s = volcano(spark, d).groupBy("tissue", "method", "fold").agg(F.avg("effect").alias("auc"))
    return A.fold_merged(s, ["tissue", "method"], "fold", "auc")


@query("SELECT tissue, method, round(mean, 6) AS mean, round(sd, 6) AS sd, n_folds, folds, row_number() OVER (PARTITION BY tissue ORDER BY round(mean, 9) DESC, method) AS place FROM merged", VOLCANO, MERGED)
def l10_w8_fold_merged(spark: SparkSession, d: str) -> DataFrame:
    return rounded(merged(spark, d), 6, "mean", "sd").withColumn("place", F.col("place").cast("long"))


@query("SELECT tissue, round(max(mean) FILTER (WHERE method = 'F'), 6) AS F, round(max(mean) FILTER (WHERE method = 'O'), 6) AS O FROM merged GROUP BY tissue", VOLCANO, MERGED)
def l10_best_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.best_matrix(merged(spark, d), "tissue", "method", "mean", ["F", "O"]), 6, "F", "O")


@query(
    """, m AS (SELECT a.gene AS ga, a.sample, a.value AS x, b.value AS y FROM expression a JOIN expression b ON a.sample = b.sample AND b.gene = (a.gene + 1) % 64)
    SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM m""",
    EXPRESSION,
)
def m14_flat_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Two matrices' values over common genes and samples as one correlation; the second is the first with its genes moved by one."""
    a = expression(spark, d).select("gene", "sample", F.col("value").alias("x"))
    b = expression(spark, d).select(F.pmod(F.col("gene") - 1, F.lit(64)).alias("gene"), "sample", F.col("value").alias("y"))
    return a.join(b, ["gene", "sample"]).agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


TISSUE_GROUPS = {"Economy": ("economy", "standard"), "Metal": ("brass", "steel", "nickel"), "Large": ("large", "medium")}


@query(
    """SELECT CASE WHEN lower(p_type) LIKE '%economy%' OR lower(p_type) LIKE '%standard%' THEN 'Economy' WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%nickel%' THEN 'Metal'
      WHEN lower(p_type) LIKE '%large%' OR lower(p_type) LIKE '%medium%' THEN 'Large' ELSE 'Other' END AS part_group, count(*) AS n FROM part GROUP BY 1"""
)
def f21_grouped_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(A.grouped_names(F.col("p_type"), TISSUE_GROUPS).alias("part_group")).agg(F.count("*").alias("n"))


@query(
    f""", mods AS (SELECT DISTINCT gene % 8 AS module, gene FROM sig WHERE gene % 8 < 4), per AS (SELECT DISTINCT CAST(module AS VARCHAR) AS module, drug FROM mods JOIN evidence USING (gene)),
    every AS (SELECT * FROM per UNION ALL SELECT DISTINCT 'all', drug FROM per), n AS (SELECT count(DISTINCT drug) AS universe, (SELECT count(*) FROM ref) AS n_reference FROM per),
    x AS (SELECT module, count(*) AS d, count(*) FILTER (WHERE drug IN (SELECT drug FROM ref)) AS k FROM every GROUP BY module), y AS (SELECT *, universe AS m, n_reference AS s FROM x, n)
    SELECT module, d AS n_drugs, k AS overlap, universe, n_reference, round(d * s / m, 6) AS expected, round(k / (d * s / m), 6) AS fold_enrichment, CASE WHEN s <= m THEN round({HYPER}, 6) END AS p FROM y""",
    VOLCANO, SIGNIFICANT, EVIDENCE, REFERENCE,
)
def m43_community_drugs(spark: SparkSession, d: str) -> DataFrame:
    members = significant(spark, d).select((F.col("gene") % 8).alias("module"), "gene").filter("module < 4")
    out = A.community_drugs(members, evidence(spark, d), reference(spark, d), "module", "gene", "drug")
    return rounded(out, 6, "expected", "fold_enrichment", "p").select("module", "n_drugs", "overlap", "universe", "n_reference", "expected", "fold_enrichment", "p")


#: Replicates of the random sets: ``reps`` of (rep, gene) named drawn, for the set ``chosen``.
TESTED = """, hits AS (SELECT DISTINCT gene, e.drug, ref.drug IS NOT NULL AS is_known FROM evidence e LEFT JOIN (SELECT DISTINCT drug FROM ref) ref ON e.drug = ref.drug), every AS (SELECT 0 AS rep, gene FROM chosen UNION ALL SELECT rep, gene FROM drawn),
  counts AS (SELECT *, CASE WHEN drugs > 0 THEN overlap / drugs ELSE 0 END AS precision, overlap / (SELECT count(DISTINCT drug) FROM ref) AS recall FROM (
    SELECT r.rep, count(DISTINCT drug) AS drugs, count(DISTINCT drug) FILTER (WHERE is_known) AS overlap FROM (SELECT unnest(range(0, {reps} + 1)) AS rep) r LEFT JOIN every e ON e.rep = r.rep LEFT JOIN hits h ON h.gene = e.gene GROUP BY r.rep)),
  o AS (SELECT overlap AS oo, drugs AS od, precision AS op, recall AS orr FROM counts WHERE rep = 0)
  SELECT (SELECT count(*) FROM chosen) AS n_genes, max(oo) AS observed_overlap, max(od) AS observed_drugs, round(max(op), 9) AS observed_precision, round(max(orr), 9) AS observed_recall,
    round(avg(overlap), 6) AS null_mean, round(stddev_pop(overlap), 6) AS null_sd, median(overlap) AS null_median, min(overlap) AS null_min, max(overlap) AS null_max, round(avg(drugs), 6) AS null_mean_drugs,
    round(avg(precision), 6) AS null_mean_precision, round(avg(recall), 6) AS null_mean_recall, round(CASE WHEN stddev_pop(overlap) > 0 THEN (max(oo) - avg(overlap)) / stddev_pop(overlap) ELSE 0 END, 6) AS z, round(max(oo) / avg(overlap), 6) AS fold,
    round((1 + count(*) FILTER (WHERE overlap >= oo)) / ({reps} + 1), 9) AS p_overlap, round((1 + count(*) FILTER (WHERE round(precision, 12) >= round(op, 12))) / ({reps} + 1), 9) AS p_precision,
    round((1 + count(*) FILTER (WHERE round(recall, 12) >= round(orr, 12))) / ({reps} + 1), 9) AS p_recall FROM counts, o WHERE rep > 0"""
#: Genes of the tested set.
PANEL, REPS = 50, 1000
CHOSEN = f"chosen AS (SELECT gene FROM ranked WHERE rank <= {PANEL})"


def top_genes(spark: SparkSession, d: str) -> DataFrame:
    return ranked_parts(spark, d).filter(F.col("rank") <= PANEL).select("gene")


def _tested(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 6, "null_mean", "null_sd", "null_mean_drugs", "null_mean_precision", "null_mean_recall", "z", "fold"), 9, "observed_precision", "observed_recall", "p_overlap", "p_precision", "p_recall")


@query(
    f""", pool AS (SELECT DISTINCT gene FROM parts SEMI JOIN evidence USING (gene)), r AS (SELECT unnest(range(1, 1001)) AS rep),
    drawn AS (SELECT rep, gene FROM (SELECT rep, gene, row_number() OVER (PARTITION BY rep ORDER BY md5('42:' || rep || ':' || gene), gene) AS i FROM pool, r) WHERE i <= {PANEL})"""
    + TESTED.format(reps=REPS),
    EVIDENCE, PARTS, RANKED, REFERENCE, CHOSEN,
)
def m28_random_gene_sets(spark: SparkSession, d: str) -> DataFrame:
    return _tested(M.random_gene_sets(top_genes(spark, d), scored_parts(spark, d), evidence(spark, d), reference(spark, d), REPS))


@query(
    """, deg AS (SELECT p.gene, count(DISTINCT drug)::DOUBLE AS degree FROM parts p LEFT JOIN evidence e ON p.gene = e.gene GROUP BY p.gene),
    cuts AS (SELECT list_sort(list_distinct(quantile_cont(degree, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM deg),
    binned AS (SELECT gene, CASE WHEN len(edges) < 2 THEN 0 ELSE least(len(list_filter(edges, lambda e: e <= degree)) - 1, len(edges) - 2) END AS bin FROM deg, cuts),
    sizes AS (SELECT bin, count(*) AS n FROM chosen JOIN binned USING (gene) GROUP BY bin), r AS (SELECT unnest(range(1, 1001)) AS rep),
    drawn AS (SELECT rep, gene FROM (SELECT rep, gene, bin, row_number() OVER (PARTITION BY rep, bin ORDER BY md5('42:' || rep || ':' || gene), gene) AS i FROM binned, r) JOIN sizes USING (bin) WHERE i <= n)"""
    + TESTED.format(reps=REPS),
    EVIDENCE, PARTS, RANKED, REFERENCE, CHOSEN,
)
def m27_degree_matched(spark: SparkSession, d: str) -> DataFrame:
    return _tested(M.degree_matched(top_genes(spark, d), scored_parts(spark, d), evidence(spark, d), reference(spark, d), 5, REPS))


@query(
    """, numbered AS (SELECT gene, score, row_number() OVER (ORDER BY gene) - 1 AS i FROM parts), n AS (SELECT count(*) AS n FROM parts), r AS (SELECT unnest(range(1, 101)) AS rep),
    drawn AS (SELECT rep, CAST(('0x' || substr(md5('42:' || rep || ':' || i), 1, 12)) AS BIGINT) % n AS i FROM numbered, n, r),
    t AS (SELECT DISTINCT rep, gene FROM (SELECT rep, gene, row_number() OVER (PARTITION BY rep ORDER BY score DESC, gene) AS rank FROM drawn JOIN numbered USING (i)) WHERE rank <= 200), z AS (SELECT rep, count(*) AS n FROM t GROUP BY rep),
    s AS (SELECT a.rep AS a, b.rep AS b, count(*) AS s FROM t a JOIN t b ON a.gene = b.gene AND a.rep < b.rep GROUP BY ALL), p AS (SELECT x.n AS na, y.n AS nb, coalesce(s, 0) AS s FROM z x JOIN z y ON x.rep < y.rep LEFT JOIN s ON s.a = x.rep AND s.b = y.rep),
    u AS (SELECT gene, count(*) AS c FROM t GROUP BY gene)
    SELECT 200 AS k, (SELECT count(*) FROM z) AS n_groups, count(*) AS union_size, count(*) FILTER (WHERE c = (SELECT count(*) FROM z)) AS in_every_group, (SELECT round(avg(s / (na + nb - s)), 6) FROM p) AS mean_jaccard, (SELECT round(avg(s), 6) FROM p) AS mean_overlap FROM u""",
    PARTS,
)
def m30_bootstrap_stability(spark: SparkSession, d: str) -> DataFrame:
    out = M.bootstrap_stability(scored_parts(spark, d), [200], 100)
    return rounded(out, 6, "mean_jaccard", "mean_overlap")
