"""Readers of the text, genotype and report formats that evidence tables come in.

Paths go to Spark's readers, so any store that Spark reads will do; the ones that look at a first
line do so with a job of one row. Schemas are given or fixed, never inferred from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.functions.text import cleaned, drug_key, without_version
from evistrata.operators.ordered import numbered
from evistrata.operators.tables import resolve_columns

FAM = ["fid", "iid", "pat", "mat", "sex", "pheno"]

# Fixed names under which sources carry a column, in order of preference.
EFFECT_NAMES = ["Log2FoldChange", "logFC", "log2FC", "Effect", "Mean_Difference"]
FDR_NAMES = ["FDR", "adj.P.Val", "padj", "q_value"]
P_NAMES = ["PValue", "P.Value", "pvalue", "p_value", "P"]
SCORE_NAMES = ["Importance_Score", "Integrated_Score", "Combined_Score", "Score"]
DRUG_NAMES = ["DrugNorm", "DrugName_best", "DrugName", "drug_name", "drug", "name"]


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A file with a header, every column as text without a schema; compressed files are read as they are."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(*columns) if columns else df


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row[0] if row else ""


def whitespace_table(spark: SparkSession, path: str, names: list[str] | None = None, pattern: str = r"\s+") -> DataFrame:
    """Columns parted by a regular expression; without ``names`` the first line has them."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    header = names is None
    names = first_line(spark, path).split() if header else names
    parts = F.split(F.trim("value"), pattern)
    df = lines.select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    return df.filter(F.col(f"`{names[0]}`") != names[0]) if header else df


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Comma, tab or white space, by the header line."""
    line = first_line(spark, path)
    sep = next((s for s in ("\t", ",", ";") if s in line), None)
    return csv(spark, path, sep=sep) if sep else whitespace_table(spark, path)


def fam(spark: SparkSession, path: str) -> DataFrame:
    df = whitespace_table(spark, path, FAM)
    return df.select("fid", "iid", F.concat_ws("_", "fid", "iid").alias("sample"), F.col("sex").try_cast("int").alias("sex"), F.col("pheno").try_cast("int").alias("pheno"))


def covariates(spark: SparkSession, path: str) -> DataFrame:
    """Tab-parted, or by white space if that shows no FID and IID."""
    df = csv(spark, path, sep="\t")
    return df if {"FID", "IID"} <= set(df.columns) else whitespace_table(spark, path)


def expression(spark: SparkSession, path: str) -> DataFrame:
    """A wide samples-by-genes file to (sample, gene, value); ids without version, NaN and text as null."""
    df = sniffed(spark, path)
    genes = [c for c in df.columns if c not in ("FID", "IID")]
    long = df.select(F.concat_ws("_", "FID", "IID").alias("sample"), *(F.col(f"`{g}`") for g in genes)).unpivot(["sample"], [F.col(f"`{g}`") for g in genes], "gene", "text")
    value = F.col("text").try_cast("double")
    return long.select("sample", without_version(F.col("gene")).alias("gene"), F.when(~F.isnan(value), value).alias("value"))


def gene_count(spark: SparkSession, path: str) -> int:
    """Columns besides the two ids, from the header alone."""
    return len([c for c in sniffed(spark, path).columns if c not in ("FID", "IID")])


def results(spark: SparkSession, path: str) -> DataFrame:
    """Test results under any of their names as gene, effect, fdr, p and the rest."""
    df = resolve_columns(csv(spark, path), {"gene": ["Gene", "gene_id"], "effect": EFFECT_NAMES, "fdr": FDR_NAMES, "p": P_NAMES}, required=("gene", "effect", "fdr"))
    return df.withColumns({c: F.col(c).try_cast("double") for c in ("effect", "fdr", "p")})


def with_path_parts(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Add columns from the groups of a regular expression on each row's file path."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def fold_results(spark: SparkSession, root: str) -> DataFrame:
    """All results under ``Fold_<n>/<database>/<tissue>/<method>_<dataset>/``; folder names become columns.

    Where a combination has a corrected file (``_fixed``), its raw one is not used.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    parts = with_path_parts(raw, r"Fold_(\d+)/([^/]+)/([^/]+)/(.+)_(training|validation|test)[^/]*/[^/]*$", ["fold", "database", "tissue", "method", "dataset"])
    marked = parts.withColumn("__fixed", F.col("_metadata.file_path").contains("_fixed"))
    keys = ["fold", "database", "tissue", "method", "dataset"]
    best = marked.groupBy(*keys).agg(F.bool_or("__fixed").alias("__best"))
    return marked.join(best, keys).filter(F.col("__fixed") == F.col("__best")).drop("__fixed", "__best")


def enrichment(spark: SparkSession, root: str) -> DataFrame:
    """Enrichment tables under ``K_<k>/<source>_<direction>.csv`` with the path's parts as columns."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root)
    parts = with_path_parts(raw, r"K_(\d+)/([^/_]+)_([^/.]+)\.csv", ["k", "source", "direction"])
    named = resolve_columns(parts, {"term": ["ID", "term_id"], "name": ["Description", "term_name"], "fdr": ["p.adjust", "FDR", "qvalue"], "p": ["pvalue", "p_value"], "genes": ["geneID", "overlap_genes"], "bg_ratio": ["BgRatio", "bg_ratio"]})
    return named.withColumns({"fdr": F.col("fdr").try_cast("double"), "p": F.col("p").try_cast("double"), "k": F.col("k").cast("int"), "term_size": F.try_element_at(F.split("bg_ratio", "/"), F.lit(1)).try_cast("int")})


def ranked_list(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """(gene, symbol, score, rank): by a rank column if there is one, else by score."""
    df = resolve_columns(csv(spark, path), {"gene": ["Gene", "gene", "ensembl_gene_id"], "symbol": ["Symbol", "symbol", "gene_symbol"], "score": SCORE_NAMES, "rank": ["Rank", "rank"]}, required=("gene",))
    df = df.withColumns({"score": F.col("score").try_cast("double"), "rank": F.col("rank").try_cast("long")})
    order = [F.col("rank").asc_nulls_last(), F.col("score").desc_nulls_last(), F.col("gene").asc()]
    out = numbered(df.withColumnRenamed("rank", "__rank"), [F.col("__rank").asc_nulls_last(), *order[1:]], "rank").drop("__rank")
    return out.filter(F.col("rank") <= top) if top else out


def drug_list(spark: SparkSession, path: str, salts: bool = True) -> DataFrame:
    """Comparable drug names, each once, from the first column that holds names."""
    df = resolve_columns(csv(spark, path), {"name": DRUG_NAMES}, required=("name",))
    return df.select(drug_key(F.col("name"), salts).alias("drug")).filter("drug <> ''").distinct()


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there; FileNotFoundError if none is."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def known_genes(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = sniffed(spark, first_existing(spark, paths))
    return resolve_columns(df, {"gene": ["ensembl_gene_id", "Gene", "gene"]}, required=("gene",)).select(without_version(cleaned(F.col("gene"))).alias("gene")).filter("gene IS NOT NULL").distinct()


def metric_records(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Metric and value rows to one row a file."""
    rows = csv(spark, path).withColumn("file", F.col("_metadata.file_path"))
    wide = rows.groupBy("file").pivot("Metric", metrics).agg(F.first("Value"))
    return wide.select("file", *(F.coalesce(F.col(f"`{m}`").try_cast("double").cast("string"), F.col(f"`{m}`")).alias(m) for m in metrics))


def two_row_header(spark: SparkSession, path: str) -> DataFrame:
    """A table whose first line names groups and the second their metrics: columns ``group_metric``."""
    top, second = (x[0].split(",") for x in spark.read.text(path).head(2))
    names, group = [], ""
    for a, b in zip(top, second):
        group = a.strip() or group
        names.append(f"{group}_{b.strip()}" if group and b.strip() else group or b.strip())
    rows = spark.read.csv(path).toDF(*names)
    return rows.filter(~(F.col(f"`{names[0]}`").eqNullSafe(top[0]) | F.col(f"`{names[0]}`").eqNullSafe(second[0] or None)))


def report_sections(spark: SparkSession, path: str, heading: str = r"^(?:=+|#+)\s*(.+?)\s*(?:=+|#+)?$") -> DataFrame:
    """(file, section, line, text): lines of text reports under their latest heading."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    name = F.nullif(F.regexp_extract("text", heading, 1), F.lit(""))
    run = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(name, ignorenulls=True).over(run)).filter(name.isNull() & (F.trim("text") != ""))


def report_values(sections: DataFrame) -> DataFrame:
    """``name: number`` lines of a report."""
    pair = r"^\s*([^:]+?)\s*:\s*([-+0-9.eE]+)\s*$"
    return sections.select("file", "section", F.regexp_extract("text", pair, 1).alias("name"), F.regexp_extract("text", pair, 2).try_cast("double").alias("value")).filter("value IS NOT NULL")


def pockets(spark: SparkSession, path: str) -> DataFrame:
    """Pocket reports to (file, pocket, score, volume, hydrophobicity, density, polarity)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", r"Pocket\s+(?=\d+\s*:)")).alias("part")).filter(F.col("part").rlike(r"^\d+\s*:"))
    get = lambda name: F.regexp_extract("part", rf"{name}\s*:\s*([-0-9.]+)", 1).try_cast("double")
    return whole.select("file", F.regexp_extract("part", r"^(\d+)", 1).cast("int").alias("pocket"), get("Druggability Score").alias("score"), get("Volume").alias("volume"), get("Hydrophobicity score").alias("hydrophobicity"), get("Alpha sphere density").alias("density"), get("Polarity score").alias("polarity"))


def cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of records by key, as (key, record)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{schema}>")).alias("key", "record"))


def prefetched(spark: SparkSession, path: str, source: str) -> DataFrame:
    """What a web source returned, fetched beforehand as Parquet, with the source's name."""
    return spark.read.parquet(path).withColumn("source", F.lit(source))


def intact_gzip(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok): whether each gzip file's first kibibyte unpacks.

    Spark lists the files; tasks read their first 64 KiB through the store that pyarrow knows by
    the path.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import pyarrow.fs as pafs

        for pdf in batches:
            ok = []
            for name in pdf["path"]:
                fs, own = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name.removeprefix('file:')}")
                with fs.open_input_file(own) as f:
                    data = f.read_at(min(65536, f.size()), 0)
                try:
                    ok.append(len(zlib.decompressobj(31).decompress(data, 1024)) > 0)
                except zlib.error:
                    ok.append(False)
            yield pd.DataFrame({"path": pdf["path"], "ok": ok})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(probe, "path string, ok boolean")


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample names of a VCF header with their places."""
    head = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).limit(1)
    return head.select(F.posexplode(F.expr("slice(split(value, '\t'), 10, greatest(0, size(split(value, '\t')) - 9))")).alias("place", "sample"))


def genes_of_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(gene, symbol, chr, start, end) of the gene rows."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    get = lambda k: F.regexp_extract("_c8", rf'{k} "([^"]+)"', 1)
    return rows.filter("_c2 = 'gene'").select(without_version(get("gene_id")).alias("gene"), get("gene_name").alias("symbol"), F.regexp_replace("_c0", "^chr", "").alias("chr"), F.col("_c3").cast("int").alias("start"), F.col("_c4").cast("int").alias("end"))


def plink(spark: SparkSession, stem: str) -> DataFrame:
    """Genotypes of a bed, bim and fam trio: (snp, chr, pos, ref, alt, sample, dosage of alt).

    The bed file is cut into byte ranges of whole variants, read by the tasks through the store
    that pyarrow knows by the path; a missing call has a null dosage.
    """
    people = [r[0] for r in fam(spark, f"{stem}.fam").select("sample").collect()]  # one short row a sample
    bim = whitespace_table(spark, f"{stem}.bim", ["chr", "snp", "cm", "pos", "alt", "ref"])
    placed = bim.withColumn("__file_order", F.monotonically_increasing_id())
    place = numbered(placed, [F.asc("__file_order")], "i").withColumn("i", F.col("i") - 1).select("i", "snp", "chr", F.col("pos").cast("int").alias("pos"), "ref", "alt")
    width, uri = -(-len(people) // 4), f"{stem}.bed"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
        with fs.open_input_file(path) as f:
            if f.read_at(3, 0) != b"\x6c\x1b\x01":
                raise ValueError("not a variant-major bed file")
            for pdf in batches:
                pdf = pdf.sort_values("i")
                step = max(1, 1_000_000 // max(1, len(people)))
                for at in range(0, len(pdf), step):  # variants that follow one another are one read
                    for _, run in (part := pdf.iloc[at : at + step]).groupby((part["i"].diff() != 1).cumsum()):
                        data = np.frombuffer(f.read_at(width * len(run), 3 + int(run["i"].iloc[0]) * width), np.uint8).reshape(len(run), width)
                        code = (data[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(run), -1)[:, : len(people)]
                        own = run.loc[run.index.repeat(len(people)), ["snp", "chr", "pos", "ref", "alt"]]
                        yield own.assign(sample=people * len(run), dosage=np.array([2.0, np.nan, 1.0, 0.0])[code].ravel())

    out = place.repartitionByRange("i").mapInPandas(decode, "snp string, chr string, pos int, ref string, alt string, sample string, dosage double")
    return out.withColumn("dosage", F.when(~F.isnan("dosage"), F.col("dosage")))


def plink_packed(spark: SparkSession, stem: str) -> tuple[DataFrame, DataFrame]:
    """A bed, bim and fam trio as packed rows and the index of its samples; the file's bytes are cut, not decoded."""
    from evistrata.operators import genotypes as P

    people = fam(spark, f"{stem}.fam").select("sample")
    in_file = numbered(people.withColumn("__file_order", F.monotonically_increasing_id()), [F.asc("__file_order")], "i").select("sample", (F.col("i") - 1).alias("i"))
    bim = whitespace_table(spark, f"{stem}.bim", ["chr", "snp", "cm", "pos", "alt", "ref"])
    place = numbered(bim.withColumn("__file_order", F.monotonically_increasing_id()), [F.asc("__file_order")], "i").select((F.col("i") - 1).alias("i"), "snp", "ref", "alt")
    n = people.count()
    width, step, uri = -(-n // 4), P.BLOCK // 4, f"{stem}.bed"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
        with fs.open_input_file(path) as f:
            if f.read_at(3, 0) != b"\x6c\x1b\x01":
                raise ValueError("not a variant-major bed file")
            for batch in batches:
                for i, *variant in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    data = bytearray(f.read_at(width, 3 + i * width))
                    if n % 4:  # what follows the last sample in its byte is no call
                        keep = (1 << 2 * (n % 4)) - 1
                        data[-1] = data[-1] & keep | P.MISSING & ~keep & 0xFF
                    data += bytes([P.MISSING]) * (-len(data) % step)
                    own = [bytes(data[a : a + step]) for a in range(0, len(data), step)]
                    same = [pa.array([v] * len(own), pa.string()) for v in variant]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary())], names=[*P.VARIANT, "block", "calls"])

    return place.repartitionByRange("i").sortWithinPartitions("i").mapInArrow(cut, P.PACKED), in_file


def predictor_map(spark: SparkSession, path: str) -> DataFrame:
    """(gene, snp) from one SNP or a list of them a row."""
    df = resolve_columns(sniffed(spark, path), {"gene": ["gene"], "snps": ["snps", "snp"]}, required=("gene", "snps"))
    return df.select(without_version(F.col("gene")).alias("gene"), F.explode(F.split(F.regexp_replace("snps", r"[\[\]'\"]", ""), r"[;,|\s]+")).alias("snp")).filter("snp <> ''").distinct()



def model_files(spark: SparkSession, folder: str, prefix: str, suffix: str = ".db") -> DataFrame:
    """(tissue, path) of the weight models ``<prefix><tissue><suffix>`` in a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.expr(f"substring(element_at(split(path, '/'), -1), {len(prefix) + 1}, length(element_at(split(path, '/'), -1)) - {len(prefix) + len(suffix)})").alias("tissue"), "path").filter(F.length(name) > len(prefix) + len(suffix))


def fasta_windows(spark: SparkSession, path: str, windows: DataFrame) -> DataFrame:
    """Add ``sequence`` to windows of (chrom, start, end), places from 0 and the end left out.

    The index ``<path>.fai`` says where each sequence lies; tasks read the byte ranges through the
    store that pyarrow knows by the path. Windows are cut at the sequence's ends; one of an unknown
    sequence has a null.
    """
    index = spark.read.option("sep", "\t").schema("__name string, __length long, __offset long, __bases long, __width long").csv(f"{path}.fai")
    joined = windows.join(index, F.col("chrom") == F.col("__name"), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    names = windows.columns

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, own = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        with fs.open_input_file(own) as f:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    length, offset, bases, width = r[-4:]
                    if pd.isna(length):
                        out.append(None)
                        continue
                    a, b = max(0, int(r.start)), min(int(length), int(r.end))
                    first, last = (int(offset) + p // int(bases) * int(width) + p % int(bases) for p in (a, max(a, b)))
                    data = f.read_at(last - first, first).decode("ascii") if b > a else ""
                    out.append("".join(data.split()).upper())
                yield pdf[names].assign(sequence=out)

    return joined.select(*names, "__length", "__offset", "__bases", "__width").mapInPandas(fetch, f"{schema}, sequence string")
