"""Writers of results: partitioned tables, exports, reports, and runs that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report or LaTeX table may have; they are formatted on the driver.
REPORT_ROWS = 200


def table(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    """Parquet, partitioned by columns; rows of a partition meet first, so each has few files."""
    if by:
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def gene_list(df: DataFrame, path: str, column: str = "gene") -> None:
    """One id a line, each once, sorted."""
    df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct().orderBy("value").write.mode("overwrite").text(path)


def dosage(genotypes: DataFrame, path: str) -> None:
    """Genotypes as gzip text a chromosome: chr, snp, pos, ref, alt, mean share, then a dosage a sample in id order."""
    rows = genotypes.groupBy("chr", "snp", "pos", "ref", "alt").agg(F.avg(F.col("dosage") / 2).alias("maf"), F.array_sort(F.collect_list(F.struct("sample", F.coalesce(F.col("dosage").cast("string"), F.lit("NA")).alias("d")))).alias("all"))
    line = F.concat_ws(" ", F.concat(F.lit("chr"), "chr"), "snp", F.col("pos").cast("string"), "ref", "alt", F.format_number("maf", 4), F.array_join(F.transform("all", lambda x: x["d"]), " "))
    rows.select("chr", line.alias("value"), "pos").repartition("chr").sortWithinPartitions("chr", "pos").select("chr", "value").write.mode("overwrite").partitionBy("chr").option("compression", "gzip").text(path)


def vcf(genotypes: DataFrame, path: str) -> None:
    """Genotypes as VCF text a chromosome, in order of position: the column line, then variants with a position above 0.

    A line holds the genotypes of one variant, in sample order: 0/0, 0/1, 1/1, or ./. where missing.
    """
    call = F.when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0/1").when(F.col("dosage") == 2, "1/1").otherwise("./.")
    rows = genotypes.filter("pos > 0").groupBy("chr", "snp", "pos", "ref", "alt").agg(F.array_sort(F.collect_list(F.struct("sample", call.alias("g")))).alias("all"))
    fixed = F.concat_ws("\t", "chr", F.col("pos").cast("string"), "snp", "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join(F.transform("all", lambda x: x["g"]), "\t"))
    head = F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.array_join(F.transform("all", lambda x: x["sample"].cast("string")), "\t"))
    heads = rows.groupBy("chr").agg(F.min(head).alias("value")).select("chr", F.lit(0).alias("pos"), "value")
    lines = heads.unionByName(rows.select("chr", "pos", fixed.alias("value")))
    lines.repartition("chr").sortWithinPartitions("chr", "pos", "value").select("chr", "value").write.mode("overwrite").partitionBy("chr").text(path)


def latex(df: DataFrame, caption: str, label: str) -> str:
    """A LaTeX table of at most ``REPORT_ROWS`` rows; ValueError if there are more."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows")
    escaped = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).translate(escaped)
    body = [" & ".join(map(shown, r)) + r" \\" for r in rows]
    head = " & ".join(c.translate(escaped) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}[ht]", rf"\caption{{{caption.translate(escaped)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def report(sections: dict[str, DataFrame]) -> str:
    """Text of named sections, each of at most ``REPORT_ROWS`` rows."""
    out = []
    for name, df in sections.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name}: more than {REPORT_ROWS} rows")
        out += [f"== {name} ==", "\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows), ""]
    return "\n".join(out)


def plot_data(volcano: DataFrame, effect: str, fdr: str, bins: int = 200) -> DataFrame:
    """Counts in a grid of effect and -log10 FDR: what a volcano or heat map draws, however many rows there are."""
    x, y = F.round(F.col(effect) * bins / 40, 0), F.round(-F.log10(F.greatest(F.col(fdr), F.lit(1e-50))) * bins / 50, 0)
    return volcano.groupBy((x * 40 / bins).alias("effect"), (y * 50 / bins).alias("neg_log10_fdr")).agg(F.count("*").alias("n"))


def resumed(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys the table at ``path`` does not have; all if there is no table."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return df
    return df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
