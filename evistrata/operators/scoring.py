"""Composite, integrated and drug scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.functions.numeric import neg_log10, sigmoid, sign_label
from evistrata.functions.text import PHASE_WEIGHT, SOURCE_WEIGHT, phase_label, weight_of
from evistrata.operators.ordered import exact_percentiles, numbered
from evistrata.operators.ranking import gene_weight, percentile_ranks, ranked

# Fixed values that results depend on: (de, pathway, drug, hub, hub boost) of the weighting schemes.
SCHEMES = {
    "balanced": (0.45, 0.25, 0.25, 0.05, 0.0),
    "balanced_hub_boost": (0.45, 0.25, 0.25, 0.0, 0.10),
    "actionability_first": (0.30, 0.20, 0.45, 0.05, 0.0),
    "biology_first": (0.40, 0.45, 0.10, 0.05, 0.0),
    "de_heavy": (0.60, 0.20, 0.15, 0.05, 0.0),
    "equal": (0.25, 0.25, 0.25, 0.25, 0.0),
}
# Hits, tissues, methods, mean effect at least, and best FDR at most, of the confidence tiers.
TIERS = {"Tier1_High": (20, 5, 3, 0.75, 0.001), "Tier2_Moderate": (10, 3, 2, 0.6, 0.01)}
LOWEST_TIER = "Tier3_Exploratory"


def method_spread(sig: DataFrame, method: str = "method", effect: str = "effect", least: int = 10) -> DataFrame:
    """Median and interquartile range of effects per method with enough rows; the range is at least 1e-6."""
    q = exact_percentiles(sig, effect, [0.25, 0.5, 0.75], [method]).withColumnRenamed("percentiles", "q")
    return q.filter(F.col("n") >= least).select(F.col(method).alias("m_method"), F.col("q")[1].alias("median"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-6)).alias("iqr"))


def gene_features(sig: DataFrame, gene: str = "gene", tissue: str = "tissue", method: str = "method", database: str = "database", dataset: str = "dataset", effect: str = "effect", fdr: str = "fdr") -> DataFrame:
    """One row a gene: breadth, standardised effects, FDRs, signs and the splits it was found in.

    The spread table has one row a method. Distinct counts come from sets of small dimensions, so
    there is one shuffle by gene and no expansion.
    """
    spread = method_spread(sig, method, effect)
    z = F.coalesce(F.abs((F.col(effect) - F.col("median")) / F.col("iqr")), F.abs(effect))
    rows = sig.join(spread, F.col(method) == F.col("m_method"), "left").withColumn("__z", z)
    distinct = lambda c, when=None: F.size(F.collect_set(F.col(c) if when is None else F.when(when, F.col(c))))
    return rows.groupBy(gene).agg(
        F.count("*").alias("total_hits"), distinct(tissue).alias("n_tissues"), distinct(method).alias("n_methods"), distinct(database).alias("n_databases"),
        F.avg("__z").alias("mean_effect"), F.max("__z").alias("max_effect"), F.min(fdr).alias("min_fdr"), F.avg(fdr).alias("mean_fdr"), F.percentile(fdr, F.lit(0.5)).alias("median_fdr"),
        F.count_if(F.col(fdr) < 0.001).alias("n_highly_sig"), F.count_if(F.col(effect) > 0).alias("n_up"), F.count_if(F.col(effect) < 0).alias("n_down"),
        F.max((F.col(dataset) == "training").cast("int")).alias("in_train"), F.max((F.col(dataset) == "validation").cast("int")).alias("in_validation"),
    )


def composite_score(features: DataFrame) -> DataFrame:
    """Reproducibility, effect and confidence, weighted 0.4, 0.3 and 0.3, and their sum as ``importance``.

    A gene whose effects all have one sign has 1.1 times the effect part; one found in training and
    in validation 1.1 times the sum.
    """
    most = features.agg(*(F.max(c).alias(f"most_{c}") for c in ("total_hits", "n_tissues", "n_methods", "n_databases")))
    f = features.crossJoin(F.broadcast(most))  # one row
    share = lambda c: F.col(c) / F.col(f"most_{c}")
    repro = (0.6 * F.least(share("total_hits"), F.lit(1.0)) + 0.4 * F.least(share("n_tissues") + share("n_methods") + share("n_databases"), F.lit(1.0))) * 0.40
    one_sign = ((F.col("n_up") > 0) & (F.col("n_down") == 0)) | ((F.col("n_down") > 0) & (F.col("n_up") == 0))
    effect = (0.7 * sigmoid(F.col("mean_effect"), 2.0, 0.5) + 0.3 * sigmoid(F.col("max_effect"), 3.0, 0.4)) * 0.30 * F.when(one_sign, 1.1).otherwise(1.0)
    part = lambda c, scale: F.least(neg_log10(F.col(c), 1e-50) / scale, F.lit(1.0))
    confidence = (0.6 * part("min_fdr", 10.0) + 0.4 * part("mean_fdr", 5.0)) * 0.30
    both = (F.col("in_train") == 1) & (F.col("in_validation") == 1)
    scored = f.withColumns({"reproducibility": repro, "effect_score": effect, "confidence": confidence})
    total = (F.col("reproducibility") + F.col("effect_score") + F.col("confidence")) * F.when(both, 1.1).otherwise(1.0)
    direction = sign_label(F.col("n_up") - F.col("n_down"))
    return scored.withColumns({"importance": total, "direction": direction, "tier": confidence_tier()}).drop(*most.columns)


def confidence_tier() -> Column:
    out = F.lit(LOWEST_TIER)
    for name, (hits, tissues, methods, effect, fdr) in reversed(TIERS.items()):
        met = (F.col("total_hits") >= hits) & (F.col("n_tissues") >= tissues) & (F.col("n_methods") >= methods) & (F.col("mean_effect") >= effect) & (F.col("min_fdr") <= fdr)
        out = F.when(met, name).otherwise(out)
    return out


def gene_ranking(sig: DataFrame, gene: str = "gene") -> DataFrame:
    """Genes of the training and validation rows in order of importance, hits, mean effect, key."""
    found = composite_score(gene_features(sig.filter(F.col("dataset").isin("training", "validation")), gene))
    # Rounded before ordering: sums in different partition order differ in the last digits.
    order = [F.round("importance", 9).desc(), F.desc("total_hits"), F.round("mean_effect", 9).desc(), F.col(gene).asc()]
    return ranked(found, order)


def integrated_score(df: DataFrame, scheme: tuple[float, float, float, float, float], de: str = "de", path: str = "path", drug: str = "drug", hub: str = "hub") -> Column:
    """Weighted sum of percentile ranks; the hub part is added, or lifts the rest by a share."""
    a, b, c, h, boost = scheme
    core = a * F.col(de) + b * F.col(path) + c * F.col(drug)
    return core * (1.0 + boost * F.col(hub)) if boost else core + h * F.col(hub)


def scheme_scores(master: DataFrame, schemes: dict[str, tuple[float, float, float, float, float]], key: str = "gene") -> DataFrame:
    """(scheme, key, score): percentile ranks of all parts in one pass, then every scheme's score by ``stack``; a key has one row."""
    parts = ("de", "path", "drug", "hub")
    normed = percentile_ranks(master, key, list(parts))
    cols = normed.select(key, *(integrated_score(normed, s).alias(n) for n, s in schemes.items()))
    return cols.unpivot([key], list(schemes), "scheme", "score")


def pathway_evidence(rows: DataFrame) -> DataFrame:
    """(term, source, direction, k, fdr, term_size, genes) over many K to one row a term, source and direction."""
    weight = neg_log10(F.when(F.col("fdr") <= 0, 1e-300).otherwise(F.col("fdr")))
    genes = F.filter(F.transform(F.split("genes", "/"), lambda g: F.trim(g)), lambda g: g != "")
    return rows.groupBy("term", "source", "direction").agg(
        F.count_distinct("k").alias("support_k"), F.min("fdr").alias("best_fdr"), F.avg("fdr").alias("mean_fdr"), F.sum(weight).alias("pathway_weight"),
        F.avg("term_size").alias("avg_term_size"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(genes)))).alias("all_genes"),
    )


def gene_pathway_scores(paths: DataFrame) -> DataFrame:
    """Per gene the summed weight per support over ln(1 + term size), by direction, and their consistency."""
    share = F.col("pathway_weight") / F.greatest(F.col("support_k"), F.lit(1)) / F.log1p(F.greatest(F.col("avg_term_size"), F.lit(1.0)))
    long = paths.select("direction", share.alias("share"), F.explode("all_genes").alias("gene"))
    part = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("share"))), F.lit(0.0))
    s = long.groupBy("gene").agg(part("combined").alias("combined"), part("up").alias("up"), part("down").alias("down"), F.count("*").alias("n_pathways"))
    return s.withColumn("up_share", F.when(F.col("up") + F.col("down") > 0, F.col("up") / (F.col("up") + F.col("down"))))


def weighted_evidence(evidence: DataFrame, ranks: DataFrame, gene: str = "gene") -> DataFrame:
    """Evidence rows of ranked genes with ``weight`` = gene weight * phase weight * source weight.

    ``ranks`` has gene and score; its weights are 1 - average rank / n + 1e-6.
    """
    weights = numbered(gene_weight(ranks.select(gene, "score"), "score", "gene_weight"), [F.desc("score"), F.asc(gene)], "gene_rank").drop("score")
    label = phase_label(F.col("phase"), F.col("approved"))
    return evidence.join(weights, gene).withColumn("phase_label", label).withColumn("weight", F.col("gene_weight") * weight_of(label, PHASE_WEIGHT, 0.5) * weight_of(F.col("source"), SOURCE_WEIGHT, 1.0))


def drug_ranking(weighted: DataFrame, drug: str = "drug", gene: str = "gene") -> DataFrame:
    """Per drug: summed weight, target genes, best gene rank, sources, highest phase; in rank order."""
    level = weight_of(F.col("phase_label"), PHASE_WEIGHT, 0.5)
    d = weighted.groupBy(drug).agg(
        F.sum("weight").alias("drug_score"), F.count_distinct(gene).alias("n_target_genes"), F.min("gene_rank").alias("best_gene_rank"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.max_by("phase_label", F.struct(level, F.col("phase_label"))).alias("max_phase"),
    )
    return ranked(d, [F.round("drug_score", 4).desc(), F.desc("n_target_genes"), F.asc("best_gene_rank"), F.asc(drug)], name="drug_rank")


def shuffle_key(seed: int, rep: Column, key: Column) -> Column:
    """A portable random order: the md5 of seed, replicate and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), key.cast("string")))


def shuffled(df: DataFrame, value: str, key: str, reps: int, seed: int, only: DataFrame | None = None) -> DataFrame:
    """(rep, key, value) with the values dealt to the keys anew in each replicate, or in those of ``only``; keys are distinct.

    The i-th key in order gets the value that is i-th in the replicate's random order. Places come
    from ranges of (replicate, order), so a replicate is not one task.
    """
    from evistrata.operators.ordered import numbered, running

    every = df.select(key, value)
    rep = every.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))) if only is None else every.crossJoin(only.select("rep"))
    dealt = running(rep, [shuffle_key(seed, F.col("rep"), F.col(key)), F.col(key)], {"__i": ("sum", F.lit(1).cast("long"))}, ["rep"])
    places = numbered(df.select(key), [F.asc(key)], "__i")
    return dealt.select("rep", "__i", value).join(places, "__i").select("rep", key, value)


def permuted_drug_overlap(evidence: DataFrame, ranks: DataFrame, reference: DataFrame, ks: list[int], reps: int, seed: int = 13) -> DataFrame:
    """Per k: reference drugs among the first k by real weights, mean over shuffled weights, (1 + at least) / (1 + reps)."""
    from evistrata.operators.permutation import permuted_drug_sums
    from evistrata.operators.written import checkpointed

    weights = gene_weight(ranks.select("gene", "score"), "score", "w").drop("score")
    base = evidence.groupBy("gene", "drug").agg(F.sum(weight_of(phase_label(F.col("phase"), F.col("approved")), PHASE_WEIGHT, 0.5) * weight_of(F.col("source"), SOURCE_WEIGHT, 1.0)).alias("e"))
    real = weights.join(base, "gene").groupBy("drug").agg(F.sum(F.col("w") * F.col("e")).alias("s")).select(F.lit(0).alias("rep"), "drug", "s")
    dealt = permuted_drug_sums(ranks.select("gene", "score"), base, "score", "gene", reps, seed)
    score = real.unionByName(dealt).withColumn("s", F.round("s", 6))
    first = checkpointed(ranked(score, [F.desc("s"), F.asc("drug")], ["rep"]).filter(F.col("rank") <= max(ks)))
    hits = first.join(reference.select("drug").distinct(), "drug", "left_semi")
    at = first.select("rep").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    n = at.join(hits.select("rep", "rank"), "rep", "left").groupBy("rep", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("n"))
    observed = n.filter("rep = 0").select("k", F.col("n").alias("observed"))
    return n.filter("rep > 0").join(observed, "k").groupBy("k").agg(F.first("observed").alias("observed"), F.avg("n").alias("null_mean"), ((F.count_if(F.col("n") >= F.col("observed")) + 1) / F.lit(reps + 1.0)).alias("p"))
