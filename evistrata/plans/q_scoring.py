"""Queries on composite, integrated, pathway and drug scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.functions.pvalues import hypergeometric_p
from evistrata.operators import ranking as R
from evistrata.operators import scoring as S
from evistrata.operators import tables as T
from evistrata.plans.registry import query
from evistrata.plans.views import EVIDENCE, KNOWN, PARTS, SIGNIFICANT, VOLCANO, evidence, known, scored_parts, significant, table, volcano

FEATURES = """spread AS (SELECT method AS m_method, quantile_cont(effect, 0.5) AS median, greatest(quantile_cont(effect, 0.75) - quantile_cont(effect, 0.25), 1e-6) AS iqr
    FROM sig WHERE dataset IN ('training', 'validation') GROUP BY method HAVING count(*) >= 10),
  zed AS (SELECT s.*, coalesce(abs((effect - median) / iqr), abs(effect)) AS z FROM sig s LEFT JOIN spread ON method = m_method WHERE dataset IN ('training', 'validation')),
  feats AS (SELECT gene, count(*) AS total_hits, count(DISTINCT tissue) AS n_tissues, count(DISTINCT method) AS n_methods, count(DISTINCT database) AS n_databases,
    avg(z) AS mean_effect, max(z) AS max_effect, min(fdr) AS min_fdr, avg(fdr) AS mean_fdr, median(fdr) AS median_fdr, count(*) FILTER (WHERE fdr < 0.001) AS n_highly_sig,
    count(*) FILTER (WHERE effect > 0) AS n_up, count(*) FILTER (WHERE effect < 0) AS n_down, CAST(bool_or(dataset = 'training') AS INTEGER) AS in_train, CAST(bool_or(dataset = 'validation') AS INTEGER) AS in_validation
    FROM zed GROUP BY gene),
  parted AS (SELECT *,
    (0.6 * total_hits / max(total_hits) OVER () + 0.4 * least(1, n_tissues / max(n_tissues) OVER () + n_methods / max(n_methods) OVER () + n_databases / max(n_databases) OVER ())) * 0.4 AS repro,
    (0.7 / (1 + exp(-0.5 * (mean_effect - 2))) + 0.3 / (1 + exp(-0.4 * (max_effect - 3)))) * 0.3 * CASE WHEN (n_up > 0) <> (n_down > 0) THEN 1.1 ELSE 1 END AS eff,
    (0.6 * least(1, -log10(greatest(min_fdr, 1e-50)) / 10) + 0.4 * least(1, -log10(greatest(mean_fdr, 1e-50)) / 5)) * 0.3 AS conf FROM feats),
  ranking AS (SELECT *, (repro + eff + conf) * CASE WHEN in_train = 1 AND in_validation = 1 THEN 1.1 ELSE 1 END AS importance,
    CASE WHEN n_up > n_down THEN 'Up' WHEN n_up < n_down THEN 'Down' ELSE 'Mixed' END AS direction,
    CASE WHEN total_hits >= 20 AND n_tissues >= 5 AND n_methods >= 3 AND mean_effect >= 0.75 AND min_fdr <= 0.001 THEN 'Tier1_High'
         WHEN total_hits >= 10 AND n_tissues >= 3 AND n_methods >= 2 AND mean_effect >= 0.6 AND min_fdr <= 0.01 THEN 'Tier2_Moderate' ELSE 'Tier3_Exploratory' END AS tier FROM parted),
  ranked AS (SELECT *, row_number() OVER (ORDER BY round(importance, 9) DESC, total_hits DESC, round(mean_effect, 9) DESC, gene) AS rank FROM ranking)"""
BASE = (VOLCANO, SIGNIFICANT, FEATURES)


@query(
    "SELECT gene, rank, total_hits, n_tissues, n_methods, n_databases, direction, tier, round(importance, 6) AS importance, round(repro, 6) AS reproducibility, round(eff, 6) AS effect_score, round(conf, 6) AS confidence, round(mean_effect, 6) AS mean_effect, round(min_fdr, 6) AS min_fdr, round(median_fdr, 6) AS median_fdr, n_highly_sig FROM ranked",
    *BASE,
)
def m33_composite_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Significance filter, gene features, composite score, rank and tier."""
    r = S.gene_ranking(significant(spark, d))
    keep = ["gene", "rank", "total_hits", "n_tissues", "n_methods", "n_databases", "direction", "tier", "n_highly_sig"]
    return r.select(*keep, *(F.round(c, 6).alias(c) for c in ("importance", "reproducibility", "effect_score", "confidence", "mean_effect", "min_fdr", "median_fdr")))


@query("SELECT m_method AS method, round(median, 6) AS median, round(iqr, 6) AS iqr FROM spread", *BASE)
def a5_method_spread(spark: SparkSession, d: str) -> DataFrame:
    sig = significant(spark, d).filter(F.col("dataset").isin("training", "validation"))
    return S.method_spread(sig).select(F.col("m_method").alias("method"), F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query("SELECT tier, direction, count(*) AS n, min(rank) AS best_rank FROM ranked GROUP BY ALL", *BASE)
def f14_tiers(spark: SparkSession, d: str) -> DataFrame:
    return S.gene_ranking(significant(spark, d)).groupBy("tier", "direction").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"))


@query(
    """, v AS (SELECT 'all' AS name, gene, rank AS r FROM ranked UNION ALL SELECT 'novel', gene, rank FROM ranked WHERE gene NOT IN (SELECT gene FROM known)
      UNION ALL SELECT 'known', gene, rank FROM ranked WHERE gene IN (SELECT gene FROM known) UNION ALL SELECT 'up', gene, rank FROM ranked WHERE direction = 'Up'
      UNION ALL SELECT 'down', gene, rank FROM ranked WHERE direction = 'Down' UNION ALL SELECT 'wide', gene, rank FROM ranked WHERE n_tissues >= 2)
    SELECT name, gene, row_number() OVER (PARTITION BY name ORDER BY r) AS place FROM v QUALIFY place <= 20""",
    *BASE,
    KNOWN,
)
def w4_ranking_views(spark: SparkSession, d: str) -> DataFrame:
    """The ranking seen as a whole, novel and known genes, by direction and breadth; first twenty of each."""
    r = S.gene_ranking(significant(spark, d)).select("gene", "rank", "direction", "n_tissues").join(known(spark, d).withColumn("is_known", F.lit(True)), "gene", "left")
    views = {"all": F.lit(True), "novel": F.col("is_known").isNull(), "known": F.col("is_known").isNotNull(), "up": F.col("direction") == "Up", "down": F.col("direction") == "Down", "wide": F.col("n_tissues") >= 2}
    named = F.array(*(F.when(cond, F.lit(n)) for n, cond in views.items()))
    long = r.select("gene", "rank", F.explode(F.array_compact(named)).alias("name"))
    return R.ranked(long, [F.asc("rank")], ["name"], "place").filter("place <= 20").select("name", "gene", "place")


MASTER = """master AS (SELECT p_partkey AS gene, p_retailprice AS de, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS path, coalesce(q, 0) AS drug, coalesce(n, 0) AS hub
    FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
  normed AS (SELECT gene, """ + ", ".join(f"CASE WHEN {c} > 0 THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER () ELSE 0 END AS {c}" for c in ("de", "path", "drug", "hub")) + " FROM master)"  # fmt: skip


def master(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("de"), F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size")).cast("double").alias("path"))
    more = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("drug"), F.count_distinct("l_suppkey").cast("double").alias("hub"))
    return T.evidence_chain(base, "gene", (more, ["drug", "hub"]))


@query("SELECT gene, de, CAST(path AS DOUBLE) AS path, drug, CAST(hub AS DOUBLE) AS hub FROM master", MASTER)
def j7_evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    return master(spark, d)


SCHEME_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS scheme, gene, ({a} * de + {b} * path + {c} * drug) " + (f"* (1 + {x} * hub)" if x else f"+ {h} * hub") + " AS score FROM normed" for n, (a, b, c, h, x) in S.SCHEMES.items()
)


@query(f"SELECT scheme, gene, round(score, 12) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY round(score, 12) DESC, gene) AS rank FROM ({SCHEME_ROWS})) WHERE rank <= 200", MASTER)
def m34_integrated_scores(spark: SparkSession, d: str) -> DataFrame:
    s = S.scheme_scores(master(spark, d), S.SCHEMES).withColumn("score", F.round("score", 12))
    return R.ranked(s, [F.desc("score"), F.asc("gene")], ["scheme"]).filter("rank <= 200")


@query(
    f""", s AS (SELECT scheme, gene, round(score, 12) AS score FROM ({SCHEME_ROWS})),
    r AS (SELECT *, rank() OVER (PARTITION BY scheme ORDER BY score) + (count(*) OVER (PARTITION BY scheme, score) - 1) / 2 AS ar, row_number() OVER (PARTITION BY scheme ORDER BY score DESC, gene) AS place FROM s)
    SELECT a.scheme AS scheme, round(corr(a.ar, b.ar), 6) AS rho, count(*) FILTER (WHERE a.place <= 100 AND b.place <= 100) AS shared_top FROM r a JOIN r b ON a.gene = b.gene AND b.scheme = 'balanced' AND a.scheme <> 'balanced' GROUP BY 1""",
    MASTER,
)
def m35_weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Each scheme against the balanced one: Spearman correlation and common genes among the first hundred."""
    s = S.scheme_scores(master(spark, d), S.SCHEMES).withColumn("score", F.round("score", 12))
    r = R.ranked(s.withColumn("ar", R.average_rank("score", ["scheme"])), [F.desc("score"), F.asc("gene")], ["scheme"], "place")
    base = r.filter("scheme = 'balanced'").select("gene", F.col("ar").alias("br"), F.col("place").alias("bp"))
    return r.filter("scheme <> 'balanced'").join(base, "gene").groupBy("scheme").agg(F.round(F.corr("ar", "br"), 6).alias("rho"), F.count_if((F.col("place") <= 100) & (F.col("bp") <= 100)).alias("shared_top"))


PATHS = """paths AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS term, l_linestatus AS source, CASE l_returnflag WHEN 'A' THEN 'up' WHEN 'N' THEN 'combined' ELSE 'down' END AS direction,
      l_orderkey % 3 AS k, min(l_quantity) / 51 AS fdr, count(DISTINCT l_partkey) AS term_size, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '/') AS genes FROM lineitem GROUP BY ALL),
  terms AS (SELECT term, source, direction, count(DISTINCT k) AS support_k, min(fdr) AS best_fdr, avg(fdr) AS mean_fdr, sum(-log10(greatest(fdr, 1e-300))) AS pathway_weight, avg(term_size) AS avg_term_size,
      list_sort(list_distinct(flatten(list(string_split(genes, '/'))))) AS all_genes FROM paths GROUP BY ALL)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    term = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("term")
    direction = F.when(F.col("l_returnflag") == "A", "up").when(F.col("l_returnflag") == "N", "combined").otherwise("down").alias("direction")
    per = li.groupBy(term, F.col("l_linestatus").alias("source"), direction, (F.col("l_orderkey") % 3).alias("k"), F.col("l_partkey").cast("string").alias("gene")).agg(F.min("l_quantity").alias("quantity"))
    return per.groupBy("term", "source", "direction", "k").agg((F.min("quantity") / 51).alias("fdr"), F.count("gene").alias("term_size"), F.array_join(F.collect_list("gene"), "/").alias("genes"))


@query("SELECT term, source, direction, support_k, round(best_fdr, 9) AS best_fdr, round(mean_fdr, 9) AS mean_fdr, round(pathway_weight, 6) AS pathway_weight, round(avg_term_size, 6) AS avg_term_size, len(all_genes) AS n_genes, md5(array_to_string(all_genes, '|')) AS genes_md5 FROM terms", PATHS)
def a17_pathway_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = S.pathway_evidence(paths(spark, d))
    return e.select("term", "source", "direction", "support_k", F.round("best_fdr", 9).alias("best_fdr"), F.round("mean_fdr", 9).alias("mean_fdr"), F.round("pathway_weight", 6).alias("pathway_weight"), F.round("avg_term_size", 6).alias("avg_term_size"), F.size("all_genes").cast("long").alias("n_genes"), F.md5(F.array_join("all_genes", "|")).alias("genes_md5"))


@query(
    """, g AS (SELECT unnest(all_genes) AS gene, direction, pathway_weight / greatest(support_k, 1) / ln(1 + greatest(avg_term_size, 1)) AS share FROM terms),
    s AS (SELECT gene, coalesce(sum(share) FILTER (WHERE direction = 'combined'), 0) AS combined, coalesce(sum(share) FILTER (WHERE direction = 'up'), 0) AS up, coalesce(sum(share) FILTER (WHERE direction = 'down'), 0) AS down, count(*) AS n_pathways FROM g GROUP BY gene)
    SELECT gene, round(combined, 6) AS combined, round(up, 6) AS up, round(down, 6) AS down, n_pathways, CASE WHEN up + down = 0 THEN 'Unknown' WHEN round(up / (up + down), 6) >= 0.6 THEN 'Consistent' WHEN round(up / (up + down), 6) <= 0.4 THEN 'Opposite' ELSE 'Mixed' END AS label FROM s""",
    PATHS,
)
def a18_gene_pathway_scores(spark: SparkSession, d: str) -> DataFrame:
    from evistrata.functions.numeric import consistency_label

    s = S.gene_pathway_scores(S.pathway_evidence(paths(spark, d)))
    return s.select("gene", *(F.round(c, 6).alias(c) for c in ("combined", "up", "down")), "n_pathways", consistency_label(F.round("up_share", 6)).alias("label"))


DRUGS = """weights AS (SELECT gene, 1 - (rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () + 1e-6 AS gw, row_number() OVER (ORDER BY score DESC, gene) AS gene_rank FROM parts),
  we AS (SELECT drug, e.gene, source, gene_rank, CASE WHEN approved THEN 'APPROVED' ELSE 'PHASE' || phase END AS label,
      gw * CASE WHEN approved THEN 5.0 WHEN phase = '4' THEN 4.0 WHEN phase = '3' THEN 3.0 WHEN phase = '2' THEN 2.0 WHEN phase = '1' THEN 1.0 ELSE 0.5 END * CASE source WHEN 'OpenTargets' THEN 1.2 WHEN 'DGIdb' THEN 1.0 ELSE 0.8 END AS weight FROM evidence e JOIN weights w ON e.gene = w.gene),
  drugs AS (SELECT drug, sum(weight) AS drug_score, count(DISTINCT gene) AS n_target_genes, min(gene_rank) AS best_gene_rank, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
      arg_max(label, (CASE label WHEN 'APPROVED' THEN 5.0 WHEN 'PHASE4' THEN 4.0 WHEN 'PHASE3' THEN 3.0 WHEN 'PHASE2' THEN 2.0 WHEN 'PHASE1' THEN 1.0 ELSE 0.5 END, label)) AS max_phase FROM we GROUP BY drug),
  drug_ranks AS (SELECT *, row_number() OVER (ORDER BY round(drug_score, 4) DESC, n_target_genes DESC, best_gene_rank, drug) AS drug_rank FROM drugs)"""


def drug_ranks(spark: SparkSession, d: str) -> DataFrame:
    return S.drug_ranking(S.weighted_evidence(evidence(spark, d), scored_parts(spark, d)))


@query("SELECT drug, round(drug_score, 4) AS drug_score, n_target_genes, best_gene_rank, sources, max_phase, drug_rank FROM drug_ranks", EVIDENCE, PARTS, DRUGS)
def a11_drug_ranking(spark: SparkSession, d: str) -> DataFrame:
    return drug_ranks(spark, d).withColumn("drug_score", F.round("drug_score", 4)).withColumn("best_gene_rank", F.col("best_gene_rank").cast("long"))


@query(
    """, ref AS (SELECT s_suppkey AS drug FROM supplier WHERE s_acctbal > 5000), f AS (SELECT drug_rank, CAST(drug IN (SELECT drug FROM ref) AS INTEGER) AS hit FROM drug_ranks),
    t AS (SELECT count(*) AS predicted, (SELECT count(*) FROM supplier) AS external, sum(hit) AS ref_predicted, (SELECT count(*) FROM ref) AS ref_all FROM f),
    h AS (SELECT k, count(*) AS used, sum(hit) AS overlap FROM f, (SELECT unnest([10, 20, 50]) AS k) WHERE drug_rank <= k GROUP BY k)
    SELECT k, CAST(overlap AS BIGINT) AS overlap, round(used * ref_all / predicted, 6) AS expected_predicted, round(used * ref_all / external, 6) AS expected_external, round(overlap / used, 6) AS precision,
       round(list_sum([exp(lgamma(ref_all + 1) - lgamma(i + 1) - lgamma(ref_all - i + 1) + lgamma(external - ref_all + 1) - lgamma(used - i + 1) - lgamma(external - ref_all - used + i + 1) - lgamma(external + 1) + lgamma(used + 1) + lgamma(external - used + 1))
         for i in range(CAST(greatest(overlap, used + ref_all - external) AS BIGINT), CAST(least(used, ref_all) AS BIGINT) + 1)]), 6) AS p_external FROM h, t""",
    EVIDENCE,
    PARTS,
    DRUGS,
)
def m25_drug_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Reference drugs among the first K, under the predicted and an external universe; the former keeps the whole reference."""
    ref = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("drug"), F.lit(1).alias("is_ref"))
    flags = drug_ranks(spark, d).select("drug", "drug_rank").join(ref, "drug", "left").select("drug_rank", F.coalesce("is_ref", F.lit(0)).alias("hit"))
    totals = flags.agg(F.count("*").alias("predicted")).crossJoin(table(spark, d, "supplier").agg(F.count("*").alias("external"), F.count_if(F.col("s_acctbal") > 5000).alias("ref_all")))  # one row
    h = R.at_each_k(flags, [10, 20, 50], "drug_rank").groupBy("k").agg(F.count("*").alias("used"), F.sum("hit").alias("overlap")).crossJoin(F.broadcast(totals))
    return h.select(
        "k", "overlap", F.round(F.col("used") * F.col("ref_all") / F.col("predicted"), 6).alias("expected_predicted"), F.round(F.col("used") * F.col("ref_all") / F.col("external"), 6).alias("expected_external"),
        F.round(F.col("overlap") / F.col("used"), 6).alias("precision"), F.round(hypergeometric_p(F.col("overlap"), F.col("external"), F.col("ref_all"), F.col("used")), 6).alias("p_external"),
    )


@query(
    """, w0 AS (SELECT gene, 1 - (rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () + 1e-6 AS w FROM parts), r AS (SELECT unnest(range(0, 1001)) AS rep),
    o AS (SELECT rep, gene, w, row_number() OVER (PARTITION BY rep ORDER BY gene) AS i, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5(concat_ws(':', '13', CAST(rep AS VARCHAR), CAST(gene AS VARCHAR))) END, gene) AS j FROM w0, r),
    x AS (SELECT b.rep, b.gene, a.w FROM o a JOIN o b ON a.rep = b.rep AND a.j = b.i),
    base AS (SELECT gene, drug, sum(CASE WHEN approved THEN 5.0 WHEN phase = '4' THEN 4.0 WHEN phase = '3' THEN 3.0 WHEN phase = '2' THEN 2.0 WHEN phase = '1' THEN 1.0 ELSE 0.5 END * CASE source WHEN 'OpenTargets' THEN 1.2 WHEN 'DGIdb' THEN 1.0 ELSE 0.8 END) AS e FROM evidence GROUP BY ALL),
    s AS (SELECT rep, drug, round(sum(w * e), 6) AS s FROM x JOIN base USING (gene) GROUP BY ALL), f AS (SELECT rep, drug, row_number() OVER (PARTITION BY rep ORDER BY s DESC, drug) AS rank FROM s),
    n AS (SELECT k, rep, count(*) FILTER (WHERE rank <= k AND drug IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)) AS n FROM f, (SELECT unnest([10, 20]) AS k) GROUP BY ALL)
    SELECT n.k, max(o.n) AS observed, round(avg(n.n), 6) AS null_mean, round((count(*) FILTER (WHERE n.n >= o.n) + 1) / 1001, 6) AS p FROM n JOIN n o ON o.k = n.k AND o.rep = 0 WHERE n.rep > 0 GROUP BY n.k""",
    EVIDENCE, PARTS,
)
def m26_gene_weight_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Gene weights shuffled over genes, a thousand times."""
    ref = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("drug"))
    out = S.permuted_drug_overlap(evidence(spark, d), scored_parts(spark, d), ref, [10, 20], reps=1000)
    return out.withColumns({c: F.round(c, 6) for c in ("null_mean", "p")})


@query(
    """, w AS (SELECT e.*, p_size > 40 AS is_known FROM evidence e JOIN part ON gene = p_partkey)
    SELECT drug, count(*) AS n_rows, count(DISTINCT gene) AS n_genes, count(*) FILTER (WHERE approved) AS n_approved, bool_or(is_known) AS any_known, CAST(max(CAST(phase AS INTEGER)) AS INTEGER) AS top_phase FROM w GROUP BY drug""",
    EVIDENCE,
)
def a12_conditional_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") > 40).alias("is_known")), "gene")
    return e.groupBy("drug").agg(F.count("*").alias("n_rows"), F.count_distinct("gene").alias("n_genes"), F.count_if("approved").alias("n_approved"), F.bool_or("is_known").alias("any_known"), F.max(F.col("phase").cast("int")).alias("top_phase"))


@query("SELECT gene, string_agg(DISTINCT source, '; ' ORDER BY source) AS source, string_agg(DISTINCT phase, '; ' ORDER BY phase) AS phase FROM evidence GROUP BY gene", EVIDENCE)
def a14_metadata_collapse(spark: SparkSession, d: str) -> DataFrame:
    return T.collapsed(evidence(spark, d), ["gene"], ["source", "phase"])


@query(
    """, n AS (SELECT drug, source, count(*) AS c, row_number() OVER (PARTITION BY drug ORDER BY count(*) DESC, source) AS r FROM evidence GROUP BY drug, source)
    SELECT drug, string_agg(source || '(' || c || ')', ', ' ORDER BY r) AS top_labels FROM n WHERE r <= 2 GROUP BY drug""",
    EVIDENCE,
)
def a20_top_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.top_labels(evidence(spark, d), "drug", "source", 2)


@query(
    """, pair AS (SELECT gene, drug, count(*) AS n, min(phase) FILTER (WHERE phase <> '0') AS first_phase, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM evidence GROUP BY ALL)
    SELECT r.drug, r.drug_rank, w.gene_rank, p.gene, p.n, p.first_phase, p.sources FROM pair p JOIN drug_ranks r ON p.drug = r.drug JOIN weights w ON p.gene = w.gene WHERE drug_rank <= 20""",
    EVIDENCE,
    PARTS,
    DRUGS,
)
def j16_pair_table(spark: SparkSession, d: str) -> DataFrame:
    """Gene and drug pairs with both ranks, for the first twenty drugs."""
    w = S.weighted_evidence(evidence(spark, d), scored_parts(spark, d))
    pairs = w.groupBy("gene", "drug").agg(F.count("*").alias("n"), F.min(F.when(F.col("phase") != "0", F.col("phase"))).alias("first_phase"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.min("gene_rank").cast("long").alias("gene_rank"))
    return pairs.join(drug_ranks(spark, d).filter("drug_rank <= 20").select("drug", "drug_rank"), "drug")


@query(
    """, m AS (SELECT DISTINCT drug, gene % 50 AS disease FROM evidence), n AS (SELECT count(DISTINCT drug) AS all_drugs, (SELECT count(*) FROM drug_ranks WHERE drug_rank <= 20) AS chosen FROM m),
    t AS (SELECT disease, count(*) AS disease_drugs FROM m GROUP BY 1), x AS (SELECT disease, count(*) AS overlap FROM m WHERE drug IN (SELECT drug FROM drug_ranks WHERE drug_rank <= 20) GROUP BY 1)
    SELECT disease, disease_drugs, coalesce(overlap, 0) AS overlap, round(disease_drugs * chosen / all_drugs, 6) AS expected, round(coalesce(overlap, 0) / (disease_drugs * chosen / all_drugs), 6) AS fold_enrichment FROM t LEFT JOIN x USING (disease), n""",
    EVIDENCE,
    PARTS,
    DRUGS,
)
def m42_disease_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Per disease (part number modulo 50): its drugs, those among the first twenty, expected and fold enrichment."""
    m = evidence(spark, d).select("drug", (F.col("gene") % 50).alias("disease")).distinct()
    top = drug_ranks(spark, d).filter("drug_rank <= 20").select("drug").withColumn("hit", F.lit(1))
    totals = m.agg(F.count_distinct("drug").alias("all_drugs")).crossJoin(top.agg(F.count("*").alias("chosen")))  # one row
    per = m.join(top, "drug", "left").groupBy("disease").agg(F.count("*").alias("disease_drugs"), F.count("hit").alias("overlap")).crossJoin(F.broadcast(totals))
    expected = F.col("disease_drugs") * F.col("chosen") / F.col("all_drugs")
    return per.select("disease", "disease_drugs", "overlap", F.round(expected, 6).alias("expected"), F.round(F.col("overlap") / expected, 6).alias("fold_enrichment"))


@query(
    """, s AS (SELECT DISTINCT gene, fold FROM sig), r AS (SELECT fold, gene, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, gene) AS rank FROM sig GROUP BY fold, gene),
    t AS (SELECT k, fold, gene FROM r, (SELECT unnest([10, 50]) AS k) WHERE rank <= k), z AS (SELECT k, fold, count(*) AS n FROM t GROUP BY ALL),
    i AS (SELECT a.k, a.fold AS fa, b.fold AS fb, count(*) AS s FROM t a JOIN t b ON a.k = b.k AND a.gene = b.gene AND a.fold < b.fold GROUP BY ALL),
    p AS (SELECT a.k, a.n AS na, b.n AS nb, coalesce(s, 0) AS s FROM z a JOIN z b ON a.k = b.k AND a.fold < b.fold LEFT JOIN i ON i.k = a.k AND fa = a.fold AND fb = b.fold),
    u AS (SELECT k, gene, count(*) AS c FROM t GROUP BY ALL)
    SELECT u.k, (SELECT count(DISTINCT fold) FROM t) AS n_groups, count(*) AS union_size, count(*) FILTER (WHERE c = (SELECT count(DISTINCT fold) FROM t)) AS in_every_group,
       (SELECT round(avg(s / (na + nb - s)), 6) FROM p WHERE p.k = u.k) AS mean_jaccard, (SELECT round(avg(s), 6) FROM p WHERE p.k = u.k) AS mean_overlap FROM u GROUP BY u.k""",
    VOLCANO,
    SIGNIFICANT,
)
def m29_fold_stability(spark: SparkSession, d: str) -> DataFrame:
    from evistrata.operators.sets import stability_at_k

    per = significant(spark, d).groupBy("fold", "gene").agg(F.count("*").alias("n"))
    r = R.placed(per, [F.desc("n"), F.asc("gene")], ["fold"])
    out = stability_at_k(r, "fold", "gene", "rank", [10, 50])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_jaccard", "mean_overlap")})


@query("SELECT gene, min(fdr) AS min_fdr, max(abs(effect)) AS max_abs_effect, count(*) AS n FROM volcano GROUP BY gene", VOLCANO)
def a22_volcano_summary(spark: SparkSession, d: str) -> DataFrame:
    return volcano(spark, d).groupBy("gene").agg(F.min("fdr").alias("min_fdr"), F.max(F.abs("effect")).alias("max_abs_effect"), F.count("*").alias("n"))
