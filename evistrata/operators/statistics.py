"""Group tests from sufficient statistics: one aggregation, then closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.functions.pvalues import hypergeometric_p, normal_p, t_p
from evistrata.operators.ranking import average_rank, benjamini_hochberg
from evistrata.operators.written import parts_for


def _by_status(df: DataFrame, keys: list[str], value: str, status: str) -> DataFrame:
    case, v = F.col(status) == 1, F.col(value)
    parts = []
    for name, group in (("case", case), ("control", ~case)):
        x = F.when(group, v)
        parts += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"var_{name}")]
    return df.filter(v.isNotNull() & F.col(status).isNotNull()).groupBy(*keys).agg(*parts)


def welch(df: DataFrame, keys: list[str], value: str, status: str, least: int = 2) -> DataFrame:
    """Welch's test of cases against controls: difference, t and degrees of freedom.

    Keys with fewer than ``least`` on a side, or no variance on both, have no t.
    """
    s = _by_status(df, keys, value, status)
    a, b = F.col("var_case") / F.col("n_case"), F.col("var_control") / F.col("n_control")
    ok = (F.col("n_case") >= least) & (F.col("n_control") >= least) & (a + b > 0)
    diff = F.col("mean_case") - F.col("mean_control")
    df_ = (a + b) * (a + b) / (a * a / (F.col("n_case") - 1) + b * b / (F.col("n_control") - 1))
    return s.select(*keys, "n_case", "n_control", "mean_case", "mean_control", diff.alias("mean_difference"), F.when(ok, diff / F.sqrt(a + b)).alias("t"), F.when(ok, df_).alias("df"))


def with_t_p(df: DataFrame, t: str = "t", dof: str = "df") -> DataFrame:
    return df.withColumn("p", t_p(F.col(t), F.col(dof).cast("double")))


def linear(df: DataFrame, keys: list[str], value: str, status: str) -> DataFrame:
    """Least squares of value on status: slope, intercept, R2, t and degrees of freedom."""
    y, x = F.col(value), F.col(status).cast("double")
    fit = df.filter(y.isNotNull() & x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    error = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    ok = (F.col("n") > 2) & (error > 0)
    return fit.select(*keys, "n", "slope", "intercept", "r2", F.when(ok, F.col("slope") / error).alias("t"), (F.col("n") - 2).alias("df"))


def rank_sum(df: DataFrame, keys: list[str], value: str, status: str) -> DataFrame:
    """Mann-Whitney U of the cases and its normal score, corrected for ties and continuity."""
    rows = df.filter(F.col(value).isNotNull() & F.col(status).isNotNull())
    ranked = rows.withColumn("__r", average_rank(value, keys)).withColumn("__t", F.count("*").over(Window.partitionBy(*keys, value)))
    case, t = F.col(status) == 1, F.col("__t").cast("double")
    s = ranked.groupBy(*keys).agg(
        F.count_if(case).alias("n_case"), F.count_if(~case).alias("n_control"), F.sum(F.when(case, F.col("__r"))).alias("r"),
        F.sum(t * t - 1).alias("ties"),
        (F.percentile(F.when(case, F.col(value)), F.lit(0.5)) - F.percentile(F.when(~case, F.col(value)), F.lit(0.5))).alias("median_difference"),
    )
    n1, n2 = F.col("n_case").cast("double"), F.col("n_control").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5
    return s.select(*keys, "n_case", "n_control", "median_difference", u.alias("u"), F.when((n1 > 0) & (n2 > 0) & (sd > 0), F.greatest(F.lit(0.0), far) / sd).alias("z"))


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    return df.withColumn("p", normal_p(F.col(z)))


def flagged(df: DataFrame, p: str, effect: str, by: list[str], threshold: float = 0.05, least: float = 1.0) -> DataFrame:
    """Add q and the flags of significance, effect size, and direction."""
    out = benjamini_hochberg(df, p, by)
    sig, high = F.coalesce(F.col("q") < threshold, F.lit(False)), F.coalesce(F.abs(effect) >= least, F.lit(False))
    e = F.col(effect)
    return out.withColumns({"significant_fdr": sig, "high_fc": high, "significant_combined": sig & high, "upregulated": sig & high & (e > 0), "downregulated": sig & high & (e < 0)})


def gene_correlations(a: DataFrame, b: DataFrame, keys: list[str], sample: str, value: str = "value", least: int = 3) -> DataFrame:
    """Pearson correlation per key over the samples that both tables have with a value."""
    left, right = (x.filter(F.col(value).isNotNull()).select(*keys, sample, F.col(value).alias(n)) for x, n in ((a, "va"), (b, "vb")))
    return left.join(right, [*keys, sample]).groupBy(*keys).agg(F.count("*").alias("n"), F.corr("va", "vb").alias("r")).filter(F.col("n") >= least)


def mean_pyramid(r: DataFrame, levels: list[list[str]], value: str = "r") -> DataFrame:
    """Mean of means: average over each level's groups in turn, the last level's keys remaining."""
    out = r.filter(F.col(value).isNotNull() & ~F.isnan(value))
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_items"))
    return out


def change_metrics(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str = "value") -> DataFrame:
    """How values changed: mean absolute, root mean square and mean difference, and correlation."""
    joined = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys)
    d = F.col("vb") - F.col("va")
    return joined.groupBy(*by).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mean_change"), F.corr("va", "vb").alias("r"))


def spearman(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks for each pair of columns, over rows with both."""
    out = None
    for x, y in pairs:
        both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        r = both.select(*by, average_rank(x, list(by)).alias("rx"), average_rank(y, list(by)).alias("ry"))
        part = r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).select(*by, F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "rho")
        out = part if out is None else out.unionByName(part)
    return out


def over_representation(sets: DataFrame, terms: DataFrame, universe: DataFrame, group: str, term: str, item: str, least: int = 1) -> DataFrame:
    """Per group and term that share items: k of n group items in a term of M of N universe items, and the upper tail.

    Joined on the item, so pairs without a common item never arise; everything is counted within
    the universe. All three tables are dealt once, by item, to parts of about as many rows at every
    size; what is distinct, in the universe and shared is found within a part.
    """
    parts = parts_for(sets, terms, universe)
    u = universe.select(item).repartition(parts, item).distinct()
    s, t = (x.select(g, item).repartition(parts, item).distinct().join(u, item, "left_semi") for x, g in ((sets, group), (terms, term)))
    n = u.agg(F.count("*").alias("universe"))
    sizes = s.groupBy(group).agg(F.count("*").alias("set_size"))
    term_sizes = t.groupBy(term).agg(F.count("*").alias("term_size"))
    k = s.join(t, item).groupBy(group, term).agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
    out = k.join(sizes, group).join(term_sizes, term).crossJoin(F.broadcast(n))  # one row
    return out.withColumn("p", hypergeometric_p(F.col("overlap"), F.col("universe"), F.col("term_size"), F.col("set_size")))


def unit_enrichment(significant: DataFrame, units: DataFrame, unit: str, gene: str, known: DataFrame, universe: DataFrame) -> DataFrame:
    """Per unit: distinct significant genes, known ones among them, expected and fold enrichment; every unit has a row."""
    u = universe.select(gene).distinct().withColumn("__u", F.lit(1))
    marks = known.select(gene).distinct().withColumn("__known", F.lit(1))
    total = u.join(marks, gene, "left").agg(F.count("*").alias("universe"), F.count("__known").alias("known_in_universe"))
    per = significant.select(unit, gene).distinct().join(marks, gene, "left").groupBy(unit).agg(F.count("*").alias("n_genes"), F.count("__known").alias("n_known"))
    out = units.select(unit).distinct().join(per, unit, "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    expected = F.col("n_genes") * F.col("known_in_universe") / F.col("universe")
    return out.withColumn("expected", expected).withColumn("fold_enrichment", F.when(expected > 0, F.col("n_known") / expected).otherwise(0.0))


def evidence_enrichment(significant: DataFrame, unit: str, evidence: list[str], gene: str, known: DataFrame) -> DataFrame:
    """Distinct evidence tuples per unit, all and of known genes."""
    marks = known.select(gene).distinct().withColumn("__known", F.lit(1))
    distinct = significant.select(unit, *[c for c in evidence if c != unit]).distinct().join(marks, gene, "left")
    return distinct.groupBy(unit).agg(F.count("*").alias("n_evidence"), F.count("__known").alias("n_known_evidence"))


def direction_consistency(significant: DataFrame, unit: str, gene: str, effect: str) -> DataFrame:
    """Per unit the mean share of a gene's majority sign, weighted by ln(1 + its rows)."""
    sign = F.signum(effect)
    per = significant.filter(sign != 0).groupBy(unit, gene).agg(F.count("*").alias("n"), F.count_if(sign > 0).alias("up"))
    share, w = F.greatest(F.col("up"), F.col("n") - F.col("up")) / F.col("n"), F.log1p("n")
    return per.groupBy(unit).agg((F.sum(w * share) / F.sum(w)).alias("direction_consistency"))


def replication(found: DataFrame, test: DataFrame, unit: str, keys: list[str], universe_size: Column | int) -> DataFrame:
    """Per unit: distinct keys found, those significant again in the test, rate, expected and fold enrichment."""
    f, t = (x.select(unit, *keys).distinct() for x in (found, test))
    again = f.join(t.withColumn("__t", F.lit(1)), [unit, *keys], "left").groupBy(unit).agg(F.count("*").alias("n_found"), F.count("__t").alias("n_again"))
    out = again.join(t.groupBy(unit).agg(F.count("*").alias("n_test")), unit, "left").na.fill(0)
    size = universe_size if isinstance(universe_size, Column) else F.lit(universe_size)
    expected = F.col("n_found") * F.col("n_test") / size
    return out.withColumn("rate", F.col("n_again") / F.col("n_found")).withColumn("fold_enrichment", F.when(expected > 0, F.col("n_again") / expected).otherwise(0.0))


def consensus_sweep(genes: DataFrame, known: DataFrame, gene: str, thresholds: DataFrame) -> DataFrame:
    """Per threshold row (name, min_methods, min_tissues, min_databases): genes kept, known ones, fold enrichment.

    ``thresholds`` is a handful of rows that the caller writes down.
    """
    flags = genes.join(known.select(gene).distinct().withColumn("__known", F.lit(1)), gene, "left").withColumn("known", F.coalesce("__known", F.lit(0)))
    total = flags.agg(F.count("*").alias("universe"), F.sum("known").alias("n_known_all"))
    met = (F.col("n_methods") >= F.col("min_methods")) & (F.col("n_tissues") >= F.col("min_tissues")) & (F.col("n_databases") >= F.col("min_databases"))
    kept = flags.join(F.broadcast(thresholds), met).groupBy("name").agg(F.count("*").alias("n_genes"), F.sum("known").alias("n_known"))
    out = thresholds.select("name").join(kept, "name", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    expected = F.col("n_genes") * F.col("n_known_all") / F.col("universe")
    return out.withColumn("fold_enrichment", F.when(expected > 0, F.col("n_known") / expected).otherwise(0.0))


def gate(fold_enrichment: Column, p: Column) -> Column:
    """Verdict of a validation check."""
    return F.when((fold_enrichment > 1.5) & (p < 0.01), "PASS").when((fold_enrichment > 1.2) & (p < 0.05), "MARGINAL").otherwise("FAIL")
