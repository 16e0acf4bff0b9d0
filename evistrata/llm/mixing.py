"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. Within a source the buckets below its budget's
threshold are taken whole; only the bucket on the threshold is refined by the hash's next bits.
After the last level the remaining bucket is left out, so a source falls short of its target by
less than the documents of one finest bucket. Nothing is sorted but the bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm._shared import WORD, materialise, text_or_empty

#: Bits of the hash that each histogram level resolves.
LEVEL_BITS = (10, 10, 10)


def words_in(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def id_hash(col: str = "doc_id", text_col: str = "text", bits: int = sum(LEVEL_BITS)) -> Column:
    """A document's place between 0 and 2**bits, from the md5 of its id, or of its text where it has none."""
    name = F.coalesce(F.col(col).cast("string"), F.concat(F.lit("text:"), text_or_empty(text_col)))
    return F.shiftrightunsigned(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), 60 - bits)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Targets of (source, source_size): shares of the total by weight, at most ``max_repeats`` times a source's size.

    Sources by code point, null last, weigh ``weights`` in rotation. The excess of a capped source
    goes to the others by weight: with the sources in order of cap over weight, the first k are
    capped for the smallest k at which the level of the rest is within their caps. One row a
    source, so its windows are small. No sources give no rows.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto, every = tightest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    leveled = weighed.withColumn("level", rest / rest_weight).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"]
    return leveled.withColumn("final", final).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("final"), F.col("cap") / F.col("weight")) * F.col("weight")).alias("target"))


def hash_thresholds(sized: DataFrame, budgets: DataFrame, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """Per source, the hash below which documents' sizes stay within ``budget``.

    ``sized`` has source, size, hash; ``budgets`` has source, budget. A source whose documents all
    fit gets 2**bits. Each level counts only the documents of its boundary bucket.
    """
    bits, left = sum(level_bits), sum(level_bits)
    state = budgets.select(F.col("source").alias("b_source"), F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("low"), F.lit(False).alias("whole"))
    for width in level_bits:
        left -= width
        span = F.shiftright("hash", left + width) == F.shiftright("low", left + width)
        inside = sized.join(state, F.col("source").eqNullSafe(F.col("b_source")) & span & ~F.col("whole"))
        counts = inside.groupBy("b_source", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").cast("double").alias("n"), F.first("budget").alias("budget"))
        run = Window.partitionBy("b_source").orderBy("bucket")
        ran = counts.withColumn("sum", F.sum("n").over(run))
        over = F.col("sum") > F.col("budget")
        edge = ran.groupBy(F.col("b_source").alias("e_source")).agg(F.min(F.when(over, F.struct("bucket", F.expr("budget - (sum - n)").alias("rest")))).alias("edge"))
        joined = state.join(edge, F.col("b_source").eqNullSafe(F.col("e_source")), "left")
        state = materialise(
            joined.select(
                "b_source",
                F.coalesce(F.col("edge.rest"), F.col("budget")).alias("budget"),
                F.coalesce(F.shiftleft("edge.bucket", left), F.col("low")).alias("low"),
                (F.col("whole") | F.col("edge").isNull()).alias("whole"),
            ),
            "mix-level",
        )
    return state.select(F.col("b_source").alias("t_source"), F.when(F.col("whole"), F.lit(2**bits).cast("long")).otherwise(F.col("low")).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), id_hash(id_col, text_col).alias("hash")), "mix-sizes")


def source_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source of (source, size, hash): p_source, source_size, target, and how its documents are taken.

    Each is taken ``whole`` times, and once more below ``threshold``. One row a source; Spark
    broadcasts them only below the session's threshold and else splits a hot source's rows in the
    sort-merge join.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(totals, weights, max_repeats), "mix-targets")
    whole = F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), F.lit(max_repeats)).cast("long")
    plan = targets.withColumn("whole", whole)
    thresholds = hash_thresholds(sized, plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    both = plan.withColumnRenamed("source", "p_source").join(thresholds, F.col("p_source").eqNullSafe(F.col("t_source")))
    return materialise(both.select("p_source", "source_size", "target", "whole", F.when(F.col("whole") < max_repeats, F.col("threshold")).otherwise(0).alias("threshold")), "mix-plan")


def _times(hash_col: str) -> Column:
    return F.col("whole") + F.when(F.col(hash_col) < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken.

    A document is taken as often as its source's target holds the source whole, and once more if
    its hash is below the source's threshold. Null texts have size 0, a null source is a source of
    its own, equal ids share a hash and so their decision within a source, as do equal texts
    without an id. A source of size 0 has target 0.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    joined = sized.join(source_plan(sized, weights, max_repeats), F.col("source").eqNullSafe(F.col("p_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times("hash")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, as often as it takes them; texts without words are not taken."""
    plan = source_plan(_sized(docs, id_col, text_col, source_col), weights, max_repeats).select("p_source", "whole", "threshold")
    marked = docs.filter(F.col(text_col).rlike(WORD)).withColumn("__hash", id_hash(id_col, text_col))
    rows = marked.select(F.struct(*docs.columns).alias("__row"), F.col(source_col).alias("__source"), "__hash").join(plan, F.col("__source").eqNullSafe(F.col("p_source")))
    return rows.withColumn("__times", _times("__hash")).filter("__times > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select("__row.*")
