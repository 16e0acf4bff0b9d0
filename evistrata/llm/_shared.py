"""Folders that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, the word pattern of every operator.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []
_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one for a local master without it."""
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
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: short lineage, one evaluation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folder_of[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written, when all that reads them is written itself."""
    for df in tables:
        path = _folder_of.pop(df)
        _made.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Have the driver drop plans of written tables now, as executors keep the shuffle files of a plan as long as it is there."""
    spark.sparkContext._jvm.System.gc()


def release_unread(paths: list[str], df: DataFrame) -> list[str]:
    """Of written folders delete those that ``df`` does not read; the others are returned."""
    read = {part for file in df.inputFiles() for part in file.split("/")}
    kept = [path for path in paths if path.rsplit("/", 1)[1] in read]
    for path in paths:
        if path not in kept and path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)
    return kept


def written_since(begin: int) -> list[str]:
    """Folders written since ``mark`` gave ``begin``."""
    return _made[begin:]


def mark() -> int:
    """Where the list of written folders ends now."""
    return len(_made)


def release(spark: SparkSession, begin: int = 0, keep: int = 0) -> None:
    """Delete the folders written since ``begin``, but for the last ``keep``; what is left of their results cannot be read then."""
    last = len(_made) - keep
    for name in _made[begin:last]:
        _delete(spark, name)
    del _made[begin:last]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
