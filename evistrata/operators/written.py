"""Lineage cut at a table in the folder that all executors share.

A table that is read again has the size of its files, where a checkpointed plan keeps the product of
its joins' estimates: in loops of joins these numbers, and the time to multiply them, grow without end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part, about, where parts are asked for by number.
PART_ROWS = 250_000

_made: list[str] = []


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="evistrata-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root if ":/" in root else f"file://{root}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared root; ``release`` deletes it."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` evaluated once, written in ``spark.checkpoint.dir`` and read from there; a local master without it gets a temporary folder."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(*tables: DataFrame) -> int:
    """How many parts hold ``PART_ROWS`` rows each of the longest table.

    Small integers pack so well that parts of a fixed size in bytes, or a fixed number of parts, have
    more and more rows a task; a number of parts in proportion to the rows keeps a task's memory.
    """
    return max(1, -(-max(df.count() for df in tables) // PART_ROWS))


def release(spark: SparkSession) -> None:
    """Delete what was written so far; results that were not read yet cannot be read then."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
