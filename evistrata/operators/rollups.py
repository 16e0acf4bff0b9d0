"""Roll-ups of evidence by unit, pair, panel and fold, and the joins that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.functions.pvalues import hypergeometric_p


def in_order_of(df: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """Rows whose key an ordering table has, with its place; nothing is sorted until it is written."""
    return df.join(order.select(key, place), key)


def in_all_parts(df: DataFrame, part: str, key: str, value: str, parts: list[str]) -> DataFrame:
    """Keys that every named part has, one row a key and a column a part."""
    own = df.filter(F.col(part).isin(*parts)).groupBy(key).agg(*(F.max(F.when(F.col(part) == p, F.col(value))).alias(p) for p in parts), *(F.count_if(F.col(part) == p).alias(f"__{p}") for p in parts))
    every = F.lit(True)
    for p in parts:
        every &= F.col(f"__{p}") > 0
    return own.filter(every).select(key, *parts)


def repaired_transpose(df: DataFrame, target: str, chromosome: str, ids: list[str]) -> DataFrame:
    """Wide genes-by-samples rows to (sample, gene, value); genes without a name get ``chr<n>_<target>`` or their row's place."""
    name = F.trim(F.col(target).cast("string"))
    known = name.isNotNull() & ~F.lower(name).isin("", "nan", "none", "true", "false")
    gene = F.when(known & name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), F.col(chromosome).cast("string"), F.lit("_"), F.when(known, name).otherwise("unknown")))
    values = [c for c in df.columns if c not in (target, chromosome, *ids)]
    return df.select(gene.alias("gene"), *[F.col(f"`{c}`") for c in values]).unpivot(["gene"], [F.col(f"`{c}`") for c in values], "sample", "value")


def symbol_sets(map_: DataFrame, symbol: str, ident: str) -> DataFrame:
    """Per upper-case symbol its distinct ids in order, and how many."""
    s = F.upper(F.trim(F.col(symbol)))
    return map_.filter(s.isNotNull() & (s != "") & F.col(ident).isNotNull()).groupBy(s.alias("symbol")).agg(F.array_sort(F.collect_set(ident)).alias("ids")).withColumn("n", F.size("ids"))


def fold_drugs(fold_genes: DataFrame, drug_map: DataFrame, fold: str, gene: str, rank: str, weight: str, drug: str) -> DataFrame:
    """Per fold and drug over its genes: summed weight, genes, best rank; many to many, aggregated before it meets anything else.

    A gene has one row a fold, so its rows with distinct pairs are counted without telling them apart again.
    """
    return fold_genes.join(drug_map.select(gene, drug).distinct(), gene).groupBy(fold, drug).agg(F.sum(weight).alias("drug_score"), F.count("*").alias("n_genes"), F.min(rank).alias("best_rank"))


def grouped_hits(pairs: DataFrame, chosen: DataFrame, key: str, by: str) -> DataFrame:
    """Per group its chosen members: how many, and their names in order."""
    return pairs.select(by, key).distinct().join(chosen.select(key).distinct(), key, "left_semi").groupBy(by).agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "|").alias("hits"))


def merged_back(base: DataFrame, results: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All rows of ``base`` with the first result of their key; rows without one stay, none is doubled."""
    first = results.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__place = 1").drop("__place")
    return base.join(first, key, "left").withColumn("has_result", F.coalesce(F.col([c for c in results.columns if c not in key][0]).isNotNull(), F.lit(False)))


def unit_sets(df: DataFrame, unit: str, item: str, known: DataFrame) -> DataFrame:
    """Per unit: distinct items, how many of them are known, and the known ones in order."""
    marks = known.select(item).distinct().withColumn("__known", F.lit(True))
    per = df.select(unit, item).distinct().join(marks, item, "left")
    return per.groupBy(unit).agg(F.count("*").alias("n_items"), F.count("__known").alias("n_known"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("__known"), F.col(item)))), "|").alias("known_items"))


def panel(ranks: DataFrame, details: DataFrame, key: str, rank: str, label: str, n: int) -> DataFrame:
    """The first n with, of their details, the count, the distinct labels and the label of the best row."""
    top = ranks.filter(F.col(rank) <= n)
    per = details.join(top.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"), F.min_by(label, F.struct("place", label)).alias("first_label"))
    return top.join(per, key, "left").na.fill(0, ["n_rows"]).na.fill("", ["labels"])


def pair_rollup(df: DataFrame, pair: list[str], text: str, number: str, order: str) -> DataFrame:
    """Per pair: the first non-empty text in order, its distinct texts, and the number's range."""
    full = F.when(F.trim(F.col(text)) != "", F.trim(F.col(text)))
    return df.groupBy(*pair).agg(F.min_by(full, F.when(full.isNotNull(), F.struct(order, text))).alias("first_text"), F.array_join(F.array_sort(F.collect_set(full)), "|").alias("texts"), F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n"))


def recurrence(hubs: DataFrame, item: str, method: str, tissue: str, folds: str, rank: str, top: int = 30) -> DataFrame:
    """Per item over methods and tissues: how many, folds in sum, mean rank, and 2 m + 1.5 t + 0.5 a + 0.1 (50 - min(rank, 50)).

    ``hubs`` has a row an item, method and tissue, with the number of folds that have it and its mean
    rank there; the first ``top`` of each method and tissue count, by folds, then rank, then item. A
    rank that is missing counts as 999.
    """
    own = hubs.withColumn("__rank", F.coalesce(F.col(rank).cast("double"), F.lit(999.0)))
    place = F.row_number().over(Window.partitionBy(method, tissue).orderBy(F.desc(folds), "__rank", item))
    first = own.withColumn("__place", place).filter(F.col("__place") <= top)
    per = first.groupBy(item).agg(F.count_distinct(method).alias("n_methods"), F.count_distinct(tissue).alias("n_tissues"), F.sum(folds).alias("appearances"), F.avg("__rank").alias("avg_rank"))
    score = 2.0 * F.col("n_methods") + 1.5 * F.col("n_tissues") + 0.5 * F.col("appearances") + 0.1 * (50 - F.least("avg_rank", F.lit(50.0)))
    return per.withColumn("consistency", score)


def term_recurrence(terms: DataFrame, term: list[str], method: str, tissue: str) -> DataFrame:
    """Per term (pathway, process, factor or edge): rows, tissues and methods that have it."""
    return terms.groupBy(*term).agg(F.count("*").alias("n_seen"), F.count_distinct(tissue).alias("n_tissues"), F.count_distinct(method).alias("n_methods"))


def spread_over(df: DataFrame, unit: str, over: str, cols: list[str]) -> DataFrame:
    """Per unit the mean and population deviation of each column over rows of ``over``, and how many of these there are."""
    pairs = [x for c in cols for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]
    return df.groupBy(unit).agg(*pairs, F.count(over).alias(f"n_{over}s"))


def top_cells(matrix: DataFrame, row: str, column: str, value: str, n: int) -> DataFrame:
    """The n largest cells of a wide matrix in long form, ties by row and column; null cells are none."""
    cols = [c for c in matrix.columns if c != row]
    long = matrix.unpivot([row], [F.col(f"`{c}`") for c in cols], column, value).filter(F.col(value).isNotNull())
    return long.orderBy(F.desc(value), row, column).limit(n)


def common_per_pair(df: DataFrame, by: str, group: str, item: str) -> DataFrame:
    """Per pair of groups the mean over ``by`` of their common items; pairs of groups present in a ``by`` count, with 0 where nothing is common.

    A group is one of a few databases, so an item meets itself a few times.
    """
    own = df.select(by, group, item).distinct()
    there = own.select(by, group).distinct()
    a, b = (there.select(by, F.col(group).alias(x)) for x in "ab")
    pairs = a.join(b, by).filter("a < b")
    left, right = (own.select(by, item, F.col(group).alias(x)) for x in "ab")
    common = left.join(right, [by, item]).filter("a < b").groupBy(by, "a", "b").agg(F.count("*").alias("common"))
    return pairs.join(common, [by, "a", "b"], "left").groupBy("a", "b").agg(F.avg(F.coalesce("common", F.lit(0))).alias("mean_common"), F.count("*").alias("n"))


def community_drugs(members: DataFrame, drug_map: DataFrame, reference: DataFrame, module: str, gene: str, drug: str, union: str = "all") -> DataFrame:
    """Reference drugs among each module's drugs and among those of all modules together.

    The universe is the drugs of the selected modules; the reference is whole, so its size may
    exceed the universe, and then there is no p.
    """
    per = members.select(module, gene).distinct().join(drug_map.select(gene, drug).distinct(), gene).select(F.col(module).cast("string").alias("module"), drug).distinct()
    every = per.unionByName(per.select(F.lit(union).alias("module"), drug).distinct())
    ref = reference.select(drug).distinct().withColumn("__ref", F.lit(True))
    n = per.agg(F.count_distinct(drug).alias("universe")).crossJoin(ref.agg(F.count("*").alias("n_reference")))  # one row
    k = every.join(ref, drug, "left").groupBy("module").agg(F.count("*").alias("n_drugs"), F.count("__ref").alias("overlap")).crossJoin(F.broadcast(n))
    whole = (F.col("n_reference") <= F.col("universe")) & (F.col("n_drugs") <= F.col("universe"))
    expected = F.col("n_drugs") * F.col("n_reference") / F.col("universe")
    return k.withColumn("expected", expected).withColumn("fold_enrichment", F.when(expected > 0, F.col("overlap") / expected).otherwise(0.0)).withColumn("p", F.when(whole, hypergeometric_p(F.col("overlap"), F.col("universe"), F.least("n_reference", "universe"), F.least("n_drugs", "universe"))))


def fold_merged(scores: DataFrame, keys: list[str], fold: str, value: str) -> DataFrame:
    """Per combination over folds: mean, deviation, folds and their names; and its place among all with its first key."""
    per = scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count_distinct(fold).alias("n_folds"), F.array_join(F.array_sort(F.collect_set(F.col(fold).cast("string"))), "|").alias("folds"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.round("mean", 9).desc(), *keys[1:])))


def best_matrix(merged: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row an item and, for each named column, its best value; null where there is none."""
    return merged.groupBy(row).agg(*(F.max(F.when(F.col(column).cast("string") == c, F.col(value))).alias(c) for c in columns))


def grouped_names(x: Column, groups: dict[str, tuple[str, ...]], other: str = "Other") -> Column:
    """The first group any of whose words the name holds, upper and lower case alike."""
    low = F.lower(x)
    out = F.lit(other)
    for name, words in reversed(list(groups.items())):
        found = F.lit(False)
        for w in words:
            found |= low.contains(w)
        out = F.when(found, name).otherwise(out)
    return F.when(x.isNotNull(), out)
