"""Joining genetic associations: allele alignment, Wald ratios, colocalisation, genotype scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.functions.text import palindromic
from evistrata.operators.ranking import best_row


def harmonised(eqtl: DataFrame, gwas: DataFrame, flip_if_alt: bool = True) -> DataFrame:
    """Join (chr, pos, ref, alt, eqtl_beta, ..) with (chr, pos, a1, a2, ..) where the alleles agree or are swapped.

    By the rule ``flip_if_alt`` the effect changes sign where a1 is the alternative allele; without
    it, where a1 is the reference, which suits effects given per alternative allele.
    """
    same = (F.col("a1") == F.col("ref")) & (F.col("a2") == F.col("alt"))
    swapped = (F.col("a1") == F.col("alt")) & (F.col("a2") == F.col("ref"))
    turn = swapped if flip_if_alt else same
    return eqtl.join(gwas, ["chr", "pos"]).filter(same | swapped).withColumn("eqtl_beta_aligned", F.when(turn, -F.col("eqtl_beta")).otherwise(F.col("eqtl_beta")))


def best_instrument(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group the row of smallest p, then largest abs z; by z alone where no p is known."""
    return best_row(rows, by, [F.col("p").asc_nulls_last(), F.abs("z").desc_nulls_last(), F.col("chr").asc(), F.col("pos").asc()])


def wald_ratio(df: DataFrame) -> DataFrame:
    """Ratio of effects, delta-method error and z; null where the exposure effect is about zero."""
    ok = F.abs("eqtl_beta_aligned") >= 1e-12
    b, g = F.col("eqtl_beta_aligned"), F.col("gwas_beta")
    se = F.sqrt(F.pow("gwas_se", 2) / F.pow(b, 2) + F.pow(g, 2) * F.pow("eqtl_se", 2) / F.pow(b, 4))
    out = df.withColumn("mr_beta", F.when(ok, g / b)).withColumn("mr_se", F.when(ok, se))
    return out.withColumn("mr_z", F.when(F.col("mr_se") > 0, F.col("mr_beta") / F.col("mr_se")))


def mr_label(p: str = "p", q: str = "q"):
    return F.when(F.col(q) < 0.05, "FDR<0.05").when(F.col(q) < 0.10, "FDR<0.10").when(F.col(p) < 0.05, "Nominal_P<0.05").otherwise("NS")


def colocalised(df: DataFrame, by: list[str], least: int = 20, w1: float = 0.15, w2: float = 0.2, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5) -> DataFrame:
    """Posterior probabilities of the five hypotheses on two traits' shared signal, from effects and errors.

    Wakefield's approximate Bayes factors per variant (prior deviations ``w1`` and ``w2``), summed on
    the log scale per group in two aggregations. Palindromic variants of middling frequency are
    dropped where ``maf``, ``a1`` and ``a2`` are there; groups with fewer variants than ``least`` too.
    """
    if {"maf", "a1", "a2"} <= set(df.columns):
        df = df.filter(~(palindromic(F.col("a1"), F.col("a2")) & F.col("maf").between(0.42, 0.58)))

    def log_abf(beta: str, se: str, w: float):
        r = w * w / (w * w + F.pow(se, 2))
        return 0.5 * (F.log(1 - r) + r * F.pow(F.col(beta) / F.col(se), 2))

    l1, l2 = log_abf("beta_1", "se_1", w1), log_abf("beta_2", "se_2", w2)
    rows = df.filter((F.col("se_1") > 0) & (F.col("se_2") > 0)).select(*by, l1.alias("l1"), l2.alias("l2"))
    tops = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("l1").alias("m1"), F.max("l2").alias("m2"), F.max(F.col("l1") + F.col("l2")).alias("m12")).filter(F.col("n") >= least)
    sums = rows.join(tops, by).groupBy(*by, "n", "m1", "m2", "m12").agg(F.sum(F.exp(F.col("l1") - F.col("m1"))).alias("s1"), F.sum(F.exp(F.col("l2") - F.col("m2"))).alias("s2"), F.sum(F.exp(F.col("l1") + F.col("l2") - F.col("m12"))).alias("s12"))
    a, b, c = (F.col(m) + F.log(s) for m, s in (("m1", "s1"), ("m2", "s2"), ("m12", "s12")))
    both = a + b
    apart = both + F.log(F.greatest(F.lit(1e-300), 1 - F.exp(F.least(c - both, F.lit(0.0)))))
    hyps = [F.lit(0.0), F.log(F.lit(p1)) + a, F.log(F.lit(p2)) + b, F.log(F.lit(p1)) + F.log(F.lit(p2)) + apart, F.log(F.lit(p12)) + c]
    logs = sums.select(*by, "n", F.array(*hyps).alias("h")).withColumn("top", F.array_max("h"))
    weights = F.transform("h", lambda x: F.exp(x - F.col("top")))
    total = logs.withColumn("w", weights).withColumn("t", F.aggregate("w", F.lit(0.0), lambda x, y: x + y))
    return total.select(*by, "n", *((F.col("w")[i] / F.col("t")).alias(f"pp_h{i}") for i in range(5)))


def genotype_scores(genotypes: DataFrame, weights: DataFrame) -> DataFrame:
    """Per sample and gene the sum of dosage times weight, dosages turned to the weight's allele.

    ``genotypes`` has sample, snp, ref, alt, dosage (of alt); ``weights`` gene, snp, allele, weight.
    Missing dosages are left out, not imputed; alleles that are neither ref nor alt do not count.
    """
    joined = genotypes.filter(F.col("dosage").isNotNull()).join(weights, "snp").filter((F.col("allele") == F.col("alt")) | (F.col("allele") == F.col("ref")))
    dose = F.when(F.col("allele") == F.col("alt"), F.col("dosage")).otherwise(2.0 - F.col("dosage"))
    return joined.groupBy("sample", "gene").agg(F.sum(dose * F.col("weight")).alias("score"), F.count("*").alias("n_snps"))


def variation_scores(genotypes: DataFrame, status: DataFrame) -> DataFrame:
    """Per SNP the summed difference of genotype shares of cases and controls, times 1.5 if both groups vary."""
    g = genotypes.filter(F.col("dosage").isNotNull()).join(status, "sample")
    case = F.col("status") == 1
    share = lambda k, who: F.avg(F.when(who, (F.col("dosage") == k).cast("double")))
    kinds = lambda who: F.size(F.collect_set(F.when(who, F.col("dosage"))))
    diff = sum((F.abs(share(k, case) - share(k, ~case)) for k in (0, 1, 2)), F.lit(0.0))
    return g.groupBy("snp").agg((diff * F.when((kinds(case) > 1) & (kinds(~case) > 1), 1.5).otherwise(1.0)).alias("variation"))
