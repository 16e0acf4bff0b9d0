"""Cleaning, filters, reshaping, joins and roll-ups on result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.ordered import exact_percentiles, numbered, present, running
from evistrata.operators.written import checkpointed


def resolve_columns(df: DataFrame, spec: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rename to canonical names: of each list the first column there is, in any case; else null.

    A missing column named in ``required`` raises ValueError.
    """
    have = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((have[x.lower()] for x in names if x.lower() in have), None) for name, names in spec.items()}
    if lost := [n for n in required if found.get(n) is None]:
        raise ValueError(f"no column for {', '.join(lost)}")
    used = set(found.values())
    return df.select(*(F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in found.items()), *(F.col(f"`{c}`") for c in df.columns if c not in used and c not in found))


def significant(fdr: Column, effect: Column, threshold: float = 0.1, least: float = 0.5, strict: bool = True) -> Column:
    """FDR below the threshold (or at it) and an effect of at least a size."""
    return ((fdr < threshold) if strict else (fdr <= threshold)) & (F.abs(effect) >= least)


def significant_by_class(df: DataFrame, method: str, de_methods: list[str], fdr: str, lfc: str, effect: str, threshold: float, least: float) -> DataFrame:
    """Methods of one class are judged by fold change, the others by effect, or fold change without one."""
    is_de = F.col(method).isin(*de_methods)
    value = F.when(is_de, F.col(lfc)).otherwise(F.coalesce(F.col(effect), F.col(lfc)))
    return df.withColumn("unified_effect", value).filter(significant(F.col(fdr), F.col("unified_effect"), threshold, least))


def with_fallback(df: DataFrame, effects: list[str], probabilities: list[str]) -> DataFrame:
    """First non-null effect and probability, with the name of the column it came from."""

    def first(cols: list[str], name: str) -> list[Column]:
        source = reduce(lambda rest, c: F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(rest), reversed(cols), F.lit(None).cast("string"))
        return [F.coalesce(*(F.col(c).try_cast("double") for c in cols)).alias(name), source.alias(f"{name}_source")]

    return df.select("*", *first(effects, "used_effect"), *first(probabilities, "used_p"))


def clean_volcano(df: DataFrame, effect: str, fdr: str, most_effect: float = 20.0, floor: float = 1e-50, most: float = 100.0) -> DataFrame:
    """Drop null and extreme effects, clip the FDR, add its -log10."""
    kept = df.filter(F.col(effect).isNotNull() & F.col(fdr).isNotNull() & (F.abs(effect) <= most_effect))
    clipped = F.least(F.greatest(F.col(fdr), F.lit(floor)), F.lit(1.0))
    return kept.withColumn(fdr, clipped).withColumn("neg_log10_fdr", F.least(-F.log10(F.col(fdr)), F.lit(most)))


def trim_outliers(df: DataFrame, x: str, tight: float, wide: float, most_lost: float = 0.05) -> DataFrame:
    """Keep abs(x) within ``tight``, or within ``wide`` if the tight limit loses too large a share."""
    lost = df.agg(F.avg((F.abs(x) > tight).cast("double")).alias("lost"))
    joined = df.crossJoin(F.broadcast(lost))  # one row
    return joined.filter(F.abs(x) <= F.when(F.col("lost") > most_lost, wide).otherwise(tight)).drop("lost")


def varying(df: DataFrame, gene: str, value: str, by: list[str] = (), least: float = 1e-10) -> DataFrame:
    """Rows of the genes whose sample variance reaches ``least``; one equal to it but for the last digits, which follow from the order of the rows, does."""
    keep = df.groupBy(*by, gene).agg(F.var_samp(value).alias("v")).filter(F.col("v") >= least * (1 - 1e-12)).select(*by, gene)
    return df.join(keep, [*by, gene], "left_semi")


def gene_quality(df: DataFrame, gene: str, value: str, by: list[str] = (), most_missing: float = 0.25, least_variance: float = 1e-8) -> DataFrame:
    """Missing share and variance of the genes that pass both limits."""
    q = df.groupBy(*by, gene).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing_rate"), F.var_samp(value).alias("variance"))
    return q.filter((F.col("missing_rate") <= most_missing) & (F.col("variance") >= least_variance))


def consistent_genes(quality: DataFrame, fold: str, gene: str, top: int) -> DataFrame:
    """Of the genes of every fold, those with the largest median variance."""
    n = quality.agg(F.count_distinct(fold).alias("n_folds"))
    per = quality.groupBy(gene).agg(F.count_distinct(fold).alias("n"), F.percentile("variance", F.lit(0.5)).alias("median_variance"))
    return per.crossJoin(F.broadcast(n)).filter("n = n_folds").orderBy(F.desc("median_variance"), gene).limit(top).select(gene, "median_variance")  # one row


def in_all_splits(df: DataFrame, gene: str, split: str) -> DataFrame:
    """Rows of the genes that every split has."""
    from evistrata.operators.sets import in_every

    return df.join(in_every(df.select(split, gene).distinct(), split, gene).select(gene), gene, "left_semi")


def sufficient(df: DataFrame, by: list[str], sample: str = "sample", gene: str = "gene", least_samples: int = 10, least_genes: int = 5) -> DataFrame:
    """Rows of the groups that have enough distinct samples and genes; null ones do not count, and a null group is a group.

    Both counts start before the shuffle, in two levels, so that a large group is not one set in one task.
    """
    many = lambda c, n: df.select(*by, c).filter(F.col(c).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= n).select(*(F.col(b).alias(f"__{b}") for b in by))
    for c, n in ((sample, least_samples), (gene, least_genes)):
        large = many(c, n)
        same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by))
        df = df.join(large, same, "left_semi")
    return df


def to_long(df: DataFrame, ids: list[str], key: str = "gene", value: str = "value") -> DataFrame:
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot([F.col(c) for c in ids], [F.col(f"`{c}`") for c in cols], key, value)


def coded_sex(x: Column, coded_12: Column) -> Column:
    """0/1 from words, or from 1/2 where those are the codes, or from 0/1."""
    word, number = F.lower(F.trim(x.cast("string"))), x.cast("string").try_cast("double")
    return F.when(word.isin("m", "male"), 1.0).when(word.isin("f", "female"), 0.0).when(coded_12, number - 1.0).otherwise(number)


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean-impute and scale each column (population deviation); constant columns become 0."""
    stats = df.agg(*(F.avg(c).alias(f"{c}__m") for c in cols), *(F.stddev_pop(F.col(c)).alias(f"{c}__s") for c in cols))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    filled = [(F.coalesce(F.col(c), F.col(f"{c}__m")), c) for c in cols]
    imputed = joined.select(*(c for c in df.columns if c not in cols), *(x.alias(c) for x, c in filled), *(f"{c}__m" for c in cols))
    spread = imputed.agg(*(F.stddev_pop(c).alias(f"{c}__p") for c in cols))
    scaled = imputed.crossJoin(F.broadcast(spread))  # one row
    return scaled.select(*(c for c in df.columns if c not in cols), *(F.when(F.col(f"{c}__p") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__p")).otherwise(0.0).alias(c) for c in cols))


def phenotype_coded(df: DataFrame, x: str = "pheno") -> DataFrame:
    """Add 0/1 ``status``: codes {1, 2} less one, {0, 1} as they are, else whether above the median."""
    only = lambda *allowed: F.bool_and(F.col(x).isin(*allowed) | F.col(x).isNull())
    middle = exact_percentiles(df, x, [0.5]).select(F.col("percentiles")[0].alias("middle"))
    facts = df.agg(only(0, 1).alias("is_01"), only(1, 2).alias("is_12")).join(middle, how="left", on=F.lit(True))  # one row each
    v = F.col(x)
    status = F.when(F.col("is_01"), v).when(F.col("is_12"), v - 1).otherwise((v > F.col("middle")).cast("int"))
    return df.crossJoin(F.broadcast(facts)).withColumn("status", status.cast("int")).drop("is_01", "is_12", "middle")  # one row


def dense_units(units: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """A row for every unit, with zeros where there are no statistics."""
    return units.select(key).distinct().join(stats, key, "left").na.fill(0)


def evidence_chain(base: DataFrame, key: str, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left join each table's largest values per key, missing as 0; never adds or drops rows."""
    for df, cols in tables:
        per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).alias(c) for c in cols))
        base = base.join(per, key, "left").na.fill(0, cols)
    return base


def coalesced_lookup(df: DataFrame, keys: list[str], table: DataFrame, table_key: str, value: str) -> DataFrame:
    """Value of the first of several keys that a table with one row a key knows."""
    found = []
    for i, key in enumerate(keys):
        df = df.join(table.select(F.col(table_key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), F.col(key) == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(value, F.coalesce(*found)).drop(*(f"__{x}{i}" for i in range(len(keys)) for x in "kv"))


#: Bins of a length class are so many times as wide as those of the class below; a bin's points beyond the second number are parted.
CLASS_FACTOR, BIN_POINTS = 4, 1_000_000
CLASSES = 48


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, by: list[str] = ()) -> DataFrame:
    """Points within closed ranges, by bins that grow with a range's length.

    A range of up to ``width`` falls in class 0, one of up to four times as much in class 1, and so
    on; as its class's bins are as wide as it may be, it stands in two of them at the most. A point
    stands in one bin of each class that any range has, so it meets ranges of its own neighbourhood
    alone, whether these are single positions or whole chromosomes. Bins with very many points are
    parted, and their ranges stand in each part. Reversed ranges, and nulls and NaN on either side,
    match nothing.
    """
    by = list(by)
    length = F.col(high) - F.col(low)
    kind = F.lit(CLASSES - 1)
    for k in range(CLASSES - 2, -1, -1):
        kind = F.when(length <= float(width) * float(CLASS_FACTOR) ** k, k).otherwise(kind)
    own = ranges.filter(F.col(low) <= F.col(high)).withColumn("__class", kind)
    classes = sorted(r[0] for r in own.select("__class").distinct().collect())  # as many as there are classes, at the most
    size = F.lit(float(width)) * F.pow(F.lit(float(CLASS_FACTOR)), "__class")
    bin_of_ = lambda c: F.floor(F.col(c) / size)
    left = points.withColumn("__class", F.explode(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>"))).withColumn("__bin", bin_of_(at))
    right = own.withColumn("__bin", F.explode(F.sequence(bin_of_(low), bin_of_(high))))
    key = [*by, "__class", "__bin"]
    full = left.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > BIN_POINTS).select(*key, F.ceil(F.col("__n") / BIN_POINTS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(full, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    right = right.join(full, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*key, "__part"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("__class", "__bin", "__part")


def range_summary(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, key: str, value: str) -> DataFrame:
    """(key, n, first): how many points lie in a key's closed ranges, and the smallest ``value`` of them; no row without points.

    No pair of a point and a range is made. Points' distinct places are numbered, a range is an
    interval of numbers, and an interval is parted into at most two blocks of each power of two,
    whose counts and smallest values are at hand. Reversed ranges, nulls and NaN match nothing.
    """
    place = points.filter(present(points, at)).groupBy(F.col(at).alias("__x")).agg(F.count("*").alias("__n"), F.min(value).alias("__min"))
    place = checkpointed(numbered(place, [F.asc("__x")], "__r").withColumn("__r", F.col("__r") - 1))
    levels = max(1, place.count().bit_length())
    powers = lambda: F.explode(F.sequence(F.lit(0), F.lit(levels)))
    blocks = place.select("__n", "__min", "__r", powers().alias("__k")).groupBy("__k", F.expr("shiftright(__r, __k)").alias("__b")).agg(F.sum("__n").alias("__n"), F.min("__min").alias("__min"))
    own = ranges.filter(present(ranges, low) & present(ranges, high) & (F.col(low) <= F.col(high))).select(F.col(key).alias("__key"), F.col(low).alias("__low"), F.col(high).alias("__high"))
    own = checkpointed(numbered(own, [F.asc("__low"), F.asc("__high"), F.asc("__key")], "__id"))
    # Of places and ends in order, a low end stands before a place that is equal to it, and a high one behind.
    ends = own.select("__id", F.explode(F.array(F.struct(F.col("__low").alias("x"), F.lit(0).alias("kind")), F.struct(F.col("__high").alias("x"), F.lit(2).alias("kind")))).alias("e"))
    every = place.select(F.lit(None).cast("long").alias("__id"), F.col("__x").alias("x"), F.lit(1).alias("kind")).unionByName(ends.select("__id", "e.x", "e.kind"))
    upto = running(every, [F.asc("x"), F.asc("kind"), F.asc("__id")], {"__p": ("sum", (F.col("kind") == 1).cast("long"))}).filter("__id IS NOT NULL")
    spans = upto.groupBy("__id").agg(F.max(F.when(F.col("kind") == 0, F.col("__p"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("__p"))).alias("b")).filter("a < b")
    each = spans.select("__id", "a", "b", powers().alias("__k")).selectExpr("__id", "__k", "shiftright(a + shiftleft(1L, __k) - 1, __k) AS l", "shiftright(b, __k) AS r").filter("l < r")
    cover = each.select("__id", "__k", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), x -> x IS NOT NULL)")).alias("__b"))
    found = cover.join(blocks, ["__k", "__b"]).groupBy("__id").agg(F.sum("__n").alias("n"), F.min("__min").alias("first"))
    return found.join(own, "__id").groupBy(F.col("__key").alias(key)).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def positional_join(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """Row i beside row i of two ordered tables, as far as the shorter goes.

    For compatibility with sources without keys alone; join by key where there is one.
    """
    return numbered(a, order_a, "__i").join(numbered(b, order_b, "__i"), "__i").drop("__i")


def full_merge(tables: list[DataFrame], keys: list[str], fill: float = 0.0) -> DataFrame:
    """Full outer join of tables with distinct value columns, missing values filled."""
    out = reduce(lambda a, b: a.join(b, keys, "full"), tables)
    return out.na.fill(fill, [c for c in out.columns if c not in keys])


def collapsed(df: DataFrame, key: list[str], cols: list[str], sep: str = "; ") -> DataFrame:
    """One row a key; each column's distinct non-empty texts, sorted and joined."""
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return df.groupBy(*key).agg(*(F.array_join(F.array_sort(F.collect_set(text(c))), sep).alias(c) for c in cols))


def first_by(value: str | Column, order: str | Column) -> Column:
    """The value of the first row in order that has one."""
    v, o = (F.col(x) if isinstance(x, str) else x for x in (value, order))
    return F.min_by(v, F.when(v.isNotNull(), o))


def top_labels(df: DataFrame, key: str, label: str, n: int = 5) -> DataFrame:
    """Per key the n most frequent labels as ``label(count), ...``; ties by label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("c"), label)
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    item = F.concat(F.col(label).cast("string"), F.lit("("), F.col("c").cast("string"), F.lit(")"))
    shown = F.array_sort(F.collect_list(F.struct("r", item.alias("s"))))
    return top.groupBy(key).agg(F.array_join(F.transform(shown, lambda x: x["s"]), ", ").alias("top_labels"))


def normal_interval(x: str) -> list[Column]:
    """n, mean, sample deviation and the 95 % interval of the mean."""
    mean, sd, n = F.avg(x), F.stddev_samp(x), F.count(x)
    half = 1.96 * sd / F.sqrt(n)
    return [n.alias("n"), mean.alias("mean"), sd.alias("sd"), (mean - half).alias("ci_low"), (mean + half).alias("ci_high")]


def completeness(expected: DataFrame, done: DataFrame, keys: list[str], by: list[str], over: str) -> DataFrame:
    """Per ``by`` a 0/1 column for each value of ``over``: whether all expected combinations are done."""
    flags = expected.join(done.select(*keys).distinct().withColumn("__done", F.lit(1)), keys, "left")
    whole = flags.groupBy(*by, over).agg(F.min(F.coalesce("__done", F.lit(0))).alias("complete"))
    return whole.groupBy(*by).pivot(over).agg(F.first("complete")).na.fill(0)


def to_do(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected combinations without a result yet."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")
