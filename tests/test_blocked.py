"""Block gzip tables: many tasks, columns and filters, against the plain read."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from evistrata.sources import blocked as B


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng = random.Random(1)
    lines = ["gene,tissue,p,note,n"]
    lines += [f"g{i % 97},t{i % 5},{rng.random() if i % 11 else 'NA'},{'long ' * rng.randint(0, 40)}é,{i if i != 5000 else 'x'}" for i in range(20_000)]
    data = ("\n".join(lines) + "\n").encode()
    root = tmp_path_factory.mktemp("blocked")
    (root / "a.csv.bgz").write_bytes(B.block_gzip(data, 5_000))
    (root / "plain.csv.gz").write_bytes(gzip.compress(data))
    (root / "text.csv").write_bytes(data)
    return root


def test_it_is_gzip(made):
    assert gzip.decompress((made / "a.csv.bgz").read_bytes()) == (made / "text.csv").read_bytes()


@pytest.mark.parametrize("range_bytes", [1_000, 7_919, 40_000, 10**9])
def test_ranges_cover_every_line_once(spark, made, range_bytes):
    df = B.blocked_table(spark, str(made / "a.csv.bgz"), "n string, gene string", range_bytes=range_bytes)
    size = (made / "a.csv.bgz").stat().st_size
    assert df.rdd.getNumPartitions() == -(-size // range_bytes)
    want = spark.read.option("header", True).csv(str(made / "text.csv")).select("n", "gene")
    assert df.exceptAll(want).count() == 0 and df.count() == 20_000


def test_sniffed_types_columns_and_filters(spark, made):
    df = B.blocked_table(spark, str(made / "a.csv.bgz"), range_bytes=50_000)
    assert dict(df.dtypes) == {"gene": "string", "tissue": "string", "p": "double", "note": "string", "n": "bigint"}
    plain = spark.read.option("header", True).csv(str(made / "text.csv")).withColumn("p", F.col("p").try_cast("double")).withColumn("n", F.col("n").try_cast("long"))
    rule = (F.col("tissue") == "t3") & (F.col("p") < 0.2) & F.col("gene").isin("g1", "g7", "g11") & (F.col("note").contains("long"))
    got, want = df.filter(rule).select("gene", "p", "n"), plain.filter(rule).select("gene", "p", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    assert df.filter("n IS NULL").count() == 1 and df.filter("p IS NULL").count() == plain.filter("p IS NULL").count()
    reader = B.BlockedReader(df.schema, {"path": str(made / "a.csv.bgz")})
    left = list(reader.pushFilters([B.EqualTo(("tissue",), "t3"), B.IsNotNull(("p",))]))
    assert left == [] and sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == plain.filter("tissue = 't3' AND p IS NOT NULL").count()


def test_other_files_and_folders(spark, made, tmp_path):
    for name in ("plain.csv.gz", "text.csv"):
        df = B.blocked_table(spark, str(made / name), "tissue string, absent double")
        assert df.rdd.getNumPartitions() == 1 and df.groupBy("tissue").count().count() == 5 and df.filter("absent IS NOT NULL").count() == 0
    (tmp_path / "x.bgz").write_bytes(B.block_gzip(b"a\tb\n1\t2\n3\t4"))
    (tmp_path / "y.bgz").write_bytes(B.block_gzip(b"b\ta\n8\t9\n"))
    (tmp_path / "_skipped").write_bytes(b"no table")
    got = B.blocked_table(spark, f"file://{tmp_path}", "a long, b long", sep="\t")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4), (9, 8)]
    (tmp_path / "only.csv").write_bytes(b"a,b\n")
    assert B.blocked_table(spark, str(tmp_path / "only.csv"), "a long").count() == 0


def test_types_come_from_the_first_file_with_rows(spark, tmp_path):
    """A first partition without rows leaves a header alone, which would make every column text."""
    df = spark.range(0, 4_000, 1, 4).filter("id >= 1000").selectExpr("id AS k", "id + 0.5D AS total", "concat('p', id % 2) AS p")
    B.write_blocked(df, f"file://{tmp_path}/t")
    got = B.blocked_table(spark, f"file://{tmp_path}/t", range_bytes=1_000)
    assert got.dtypes == df.dtypes
    assert got.filter("p = 'p1' AND total >= 2000").count() == 1_000
    B.write_blocked(df.filter("k < 0"), f"file://{tmp_path}/none")
    assert B.blocked_table(spark, f"file://{tmp_path}/none").count() == 0
