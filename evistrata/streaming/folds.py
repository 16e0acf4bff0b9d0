"""Running summaries of result files as they come: mergeable states, one written table a batch.

A batch leaves one row a key: number, mean and squared deviations, extremes, sets of few values and
bitmaps of numbers. It stands in a folder of its batch id and replaces what an earlier try of the
same batch has left, so repeats change nothing. Reading merges the rows of all batches, and
compaction writes that merge once for the batches up to one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial(df: DataFrame, keys: list[str], value: str, sets: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """One state a key: ``n``, ``mean``, ``m2``, ``low``, ``high`` of ``value``, ``set_<c>`` and ``bits_<c>``.

    Null and NaN values do not count, though their row's sets do. ``sets`` are columns of few
    distinct values, as folds or methods; ``numbers`` are integers from 1 to 32768, of which a
    bitmap holds which there are, up to the largest, and other integers are an error.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    clean = df.withColumn("__x", x)
    states = [F.count("__x").alias("n"), F.avg("__x").alias("mean"), (F.var_pop("__x") * F.count("__x")).alias("m2"), F.min("__x").alias("low"), F.max("__x").alias("high")]
    states += [F.array_sort(F.collect_set(c)).alias(f"set_{c}") for c in sets]
    for c in numbers:
        place = F.when(F.bitmap_bucket_number(c) == 1, F.bitmap_bit_position(c)).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} is not within 1 and 32768")).cast("long"))
        whole = F.bitmap_construct_agg(place)
        states.append(F.substring(whole, F.lit(1), F.coalesce(F.floor(F.max(place) / 8).cast("int") + 1, F.lit(0))).alias(f"bits_{c}"))
    # Rows meet by key before they are aggregated: a bitmap of 4 KB a key and task is not shuffled.
    return clean.select(*dict.fromkeys([*keys, *sets, *numbers]), "__x").repartition(*keys).groupBy(*keys).agg(*states)


def _both(a: Column, b: Column) -> Column:
    """Number, mean and squared deviations of two parts together."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + apart * b["n"] / n)
    m2 = F.when(a["n"] == 0, b["m2"]).when(b["n"] == 0, a["m2"]).otherwise(a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n)
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of several batches as one a key; a key has one row a batch at the most."""
    sets, bits = ([c for c in states.columns if c.startswith(p) and c not in keys] for p in ("set_", "bits_"))
    part = F.struct("n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    all_ = [F.sort_array(F.collect_list(part)).alias("__parts"), F.min("low").alias("low"), F.max("high").alias("high")]
    all_ += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets] + [F.bitmap_or_agg(c).alias(c) for c in bits]
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    whole = states.repartition(*keys).groupBy(*keys).agg(*all_).withColumn("__all", F.aggregate("__parts", zero, _both))
    some = F.col("__all.n") > 0
    return whole.select(*keys, "__all.n", F.when(some, F.col("__all.mean")).alias("mean"), F.when(some, F.col("__all.m2")).alias("m2"), "low", "high", *sets, *bits)


def summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, std, low, high, the sets, and ``n_<c>`` for sets and bitmaps); std is that of a sample."""
    sets, bits = ([c for c in states.columns if c.startswith(p) and c not in keys] for p in ("set_", "bits_"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    counts = [F.size(c).cast("long").alias(f"n_{c.removeprefix('set_')}") for c in sets] + [F.bitmap_count(c).alias(f"n_{c.removeprefix('bits_')}") for c in bits]
    return states.select(*keys, "n", "mean", std.alias("std"), "low", "high", *(F.col(c).alias(c.removeprefix("set_")) if c.removeprefix("set_") not in keys else F.col(c) for c in sets), *counts)


def fold_in(batch: DataFrame, batch_id: int, target: str, keys: list[str], value: str, sets: list[str] = (), numbers: list[str] = ()) -> None:
    """Write a batch's states under its id, in place of those of an earlier try."""
    partial(batch, keys, value, sets, numbers).write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """What all batches so far come to: the last compacted table and the batches after it."""
    found, after = [], -1
    if _there(spark, f"{target}/compacted"):
        old = spark.read.parquet(f"{target}/compacted")
        after = old.agg(F.max("upto")).first()[0]
        found.append(old.filter(F.col("upto") == after).drop("upto"))
    if _there(spark, f"{target}/batches"):
        found.append(spark.read.parquet(f"{target}/batches").filter(F.col("batch") > after).drop("batch"))
    if not found:
        raise FileNotFoundError(f"no batch has been written to {target}")
    return merged(found[0] if len(found) == 1 else found[0].unionByName(found[1]), keys)


def compact(spark: SparkSession, target: str, keys: list[str]) -> int:
    """Merge all batches so far into one table, and return the last one's id; the batches' own folders may go then."""
    last = spark.read.parquet(f"{target}/batches").agg(F.max("batch")).first()[0]
    state(spark, target, keys).write.mode("overwrite").parquet(f"{target}/compacted/upto={last}")
    return last


def ingest_summaries(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], value: str, sets: list[str] = (), numbers: list[str] = ()) -> StreamingQuery:
    """Fold files that have come since the last run into the states under ``target``, then stop.

    The checkpoint numbers the batches; one that failed is repeated under its number.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, i: fold_in(df, i, target, keys, value, sets, numbers)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
