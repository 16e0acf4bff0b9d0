"""Readers, writers and incremental ingest on small files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from evistrata.functions import sequences as Q
from evistrata.functions import text as X
from evistrata.sources import readers as R
from evistrata.sources import writers as W
from evistrata.streaming.ingest import ingest_new


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_text_tables(spark, tmp_path):
    fam = R.fam(spark, put(tmp_path / "a.fam", "f1 i1 0 0  1 2\nf2\ti2 0 0 2 -9\n"))
    assert [tuple(r) for r in fam.orderBy("fid").collect()] == [("f1", "i1", "f1_i1", 1, 2), ("f2", "i2", "f2_i2", 2, -9)]
    cov = R.covariates(spark, put(tmp_path / "c.txt", "FID IID PC1\nf1 i1 0.5\n"))
    assert cov.first().PC1 == "0.5"
    ex = R.expression(spark, put(tmp_path / "e.csv", "FID,IID,ENSG1.3,ENSG2\nf1,i1,1.5,NaN\nf2,i2,x,2\n"))
    assert {(r.sample, r.gene): r.value for r in ex.collect()} == {("f1_i1", "ENSG1"): 1.5, ("f1_i1", "ENSG2"): None, ("f2_i2", "ENSG1"): None, ("f2_i2", "ENSG2"): 2.0}
    assert R.gene_count(spark, str(tmp_path / "e.csv")) == 2


def test_results_and_folders(spark, tmp_path):
    root = tmp_path / "run"
    put(root / "Fold_1/DB/Liver/limma_training/r.csv", "Gene,logFC,padj\ng1,1,0.01\n")
    put(root / "Fold_1/DB/Liver/limma_test/r.csv", "Gene,logFC,padj\ng1,9,0.5\n")
    put(root / "Fold_1/DB/Liver/limma_test/r_fixed.csv", "Gene,logFC,padj\ng1,2,0.02\n")
    got = R.fold_results(spark, str(root)).collect()
    assert {(r.fold, r.database, r.tissue, r.method, r.dataset, r.logFC) for r in got} == {("1", "DB", "Liver", "limma", "training", "1"), ("1", "DB", "Liver", "limma", "test", "2")}
    one = R.results(spark, str(root / "Fold_1/DB/Liver/limma_training/r.csv")).first()
    assert (one.gene, one.effect, one.fdr, one.p) == ("g1", 1.0, 0.01, None)
    with pytest.raises(ValueError, match="fdr"):
        R.results(spark, put(tmp_path / "no.csv", "Gene,logFC\ng,1\n"))


def test_lists_and_reports(spark, tmp_path):
    assert [r.gene for r in R.ranked_list(spark, put(tmp_path / "r.csv", "Gene,Importance_Score\na,1\nb,3\nc,2\n"), 2).orderBy("rank").collect()] == ["b", "c"]
    assert {r.drug for r in R.drug_list(spark, put(tmp_path / "d.csv", "drug_name\nX HCl\nx\n\n")).collect()} == {"x"}
    known = R.known_genes(spark, [str(tmp_path / "none.csv"), put(tmp_path / "k.csv", "ensembl_gene_id,z\nE1.2,1\nnan,2\n")])
    assert [r.gene for r in known.collect()] == ["E1"]
    m = R.metric_records(spark, put(tmp_path / "m.csv", "Metric,Value\nTest_AUC,0.7\nBest_Params,x\n"), ["Test_AUC", "Best_Params"]).first()
    assert (m.Test_AUC, m.Best_Params) == ("0.7", "x")
    two = R.two_row_header(spark, put(tmp_path / "t.csv", "id,A,,B\n,x,y,x\n1,2,3,4\n"))
    assert two.columns == ["id", "A_x", "A_y", "B_x"] and tuple(two.first()) == ("1", "2", "3", "4")
    s = R.report_sections(spark, put(tmp_path / "rep.txt", "== One ==\na: 1.5\n== Two ==\nb: x\nc: 2\n"))
    assert {(r.section, r.name, r.value) for r in R.report_values(s).collect()} == {("One", "a", 1.5), ("Two", "c", 2.0)}
    p = R.pockets(spark, put(tmp_path / "p_info.txt", "Pocket 1 :\n\tScore : 0.5\n\tDruggability Score : 0.8\n\tVolume : 700.5\nPocket 2 :\n\tDruggability Score : 0.1\n")).orderBy("pocket").collect()
    assert [(r.pocket, r.score, r.volume) for r in p] == [(1, 0.8, 700.5), (2, 0.1, None)]
    c = R.cache(spark, put(tmp_path / "c.json", json.dumps({"g": {"drugs": ["a"]}})), "struct<drugs:array<string>>").first()
    assert (c.key, c.record.drugs) == ("g", ["a"])


def test_genotypes(spark, tmp_path):
    put(tmp_path / "g.fam", "\n".join(f"f{i} i{i} 0 0 1 1" for i in range(5)))
    put(tmp_path / "g.bim", "1 rs1 0 100 A G\n2 rs2 0 200 C T\n")
    # Codes per sample, low bits first: 0 two alt, 1 missing, 2 one, 3 none.
    (tmp_path / "g.bed").write_bytes(b"\x6c\x1b\x01" + bytes([0b11100100, 0b00]) + bytes([0b11111111, 0b10]))
    got = {(r.snp, r.sample): r.dosage for r in R.plink(spark, str(tmp_path / "g")).collect()}
    assert [got["rs1", f"f{i}_i{i}"] for i in range(5)] == [2.0, None, 1.0, 0.0, 2.0]
    assert [got["rs2", f"f{i}_i{i}"] for i in range(5)] == [0.0, 0.0, 0.0, 0.0, 1.0]
    W.dosage(R.plink(spark, str(tmp_path / "g")), str(tmp_path / "dose"))
    assert spark.read.text(str(tmp_path / "dose")).filter("value LIKE 'chr1 rs1 100 G A 0.6250 2.0 NA 1.0 0.0 2.0'").count() == 1


def test_annotations(spark, tmp_path):
    g = R.genes_of_gtf(spark, put(tmp_path / "a.gtf", '#x\nchr1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "E1.2"; gene_name "AB";\nchr1\ts\texon\t5\t6\t.\t+\t.\tgene_id "E1.2";\n')).collect()
    assert [tuple(r) for r in g] == [("E1", "AB", "1", 5, 9)]
    v = R.vcf_samples(spark, put(tmp_path / "a.vcf", "##h\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t2\n"))
    assert [(r.place, r.sample) for r in v.collect()] == [(0, "s1"), (1, "s2")]
    (tmp_path / "z").mkdir()
    (tmp_path / "z/ok.gz").write_bytes(gzip.compress(b"x" * 5000))
    (tmp_path / "z/bad.gz").write_bytes(b"nope")
    assert {r.path.rsplit("/", 1)[1]: r.ok for r in R.intact_gzip(spark, str(tmp_path / "z")).collect()} == {"ok.gz": True, "bad.gz": False}


def test_vcf_is_written_and_read(spark, tmp_path):
    rows = [("1", f"rs{p}", p, "A", "G", s, d) for p, ds in ((30, (0.0, 1.0)), (20, (2.0, None)), (0, (1.0, 1.0))) for s, d in zip(("s1", "s2"), ds)]
    W.vcf(spark.createDataFrame(rows, "chr string, snp string, pos int, ref string, alt string, sample string, dosage double"), str(tmp_path / "v"))
    lines = [x for f in sorted((tmp_path / "v/chr=1").glob("*.txt")) for x in f.read_text().splitlines()]
    assert lines == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "1\t20\trs20\tA\tG\t.\t.\t.\tGT\t1/1\t./.", "1\t30\trs30\tA\tG\t.\t.\t.\tGT\t0/0\t0/1"]
    assert [r.sample for r in R.vcf_samples(spark, str(tmp_path / "v/chr=1")).orderBy("place").collect()] == ["s1", "s2"]


def test_models_and_sequences(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name in ("mashr_Liver.db", "mashr_Whole_Blood.db", "mashr_.db", "other.db", "mashr_x.txt"):
        (tmp_path / "m" / name).write_bytes(b"x")
    assert sorted(r.tissue for r in R.model_files(spark, str(tmp_path / "m"), "mashr_").collect()) == ["Liver", "Whole_Blood"]
    put(tmp_path / "g.fa", ">c1\nACGTA\nCCGGT\nAA\n>c2\nttt\n")
    put(tmp_path / "g.fa.fai", "c1\t12\t4\t5\t6\nc2\t3\t23\t3\t4\n")
    w = spark.createDataFrame([("c1", 3, 9), ("c1", -4, 2), ("c1", 10, 99), ("c2", 0, 3), ("c3", 0, 1), ("c1", 5, 5)], "chrom string, start long, end long")
    got = {(r.chrom, r.start): r.sequence for r in R.fasta_windows(spark, str(tmp_path / "g.fa"), w).collect()}
    assert got == {("c1", 3): "TACCGG", ("c1", -4): "AC", ("c1", 10): "AA", ("c2", 0): "TTT", ("c3", 0): None, ("c1", 5): ""}
    df = spark.createDataFrame([("ACGT", 10, [(11, "T", 2), (13, "G", 1), (99, "A", 2), (10, "GG", 2)]), ("ANX", 0, [])], "s string, start int, v array<struct<pos:int,alt:string,dosage:int>>")
    rows = df.select(Q.with_variants(F.col("s"), F.col("start"), F.col("v")), Q.one_hot(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["ATGT", "ANX"]
    assert rows[1][1] == [[1, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1]]


def test_names_from_trials_and_folders(spark):
    df = spark.createDataFrame([("MK0462 (x) Rizatriptan Benzoate 10 mg oral",), ("A/B & iv c malate",), ("null",), (None,)], "x string")
    assert [r[0] for r in df.select(X.drug_key(F.col("x"), trial=True)).collect()] == ["rizatriptan", "a b and c", "", ""]
    assert [r[0] for r in df.select(X.drug_key(F.col("x"))).collect()] == ["mk0462 rizatriptan oral", "a b and iv c malate", "null", ""]
    names = spark.createDataFrame([("Welch-t_val",), ("limma_voom_training_fixed",), ("x_test_y",), (None,)], "x string")
    alias = {"train": "training", "training": "training", "val": "validation", "test": "test"}
    assert [tuple(r) for r in names.select(*X.method_and_split(F.col("x"), alias)).collect()] == [("welch_t", "validation"), ("limma_voom", "training"), (None, None), (None, None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b_&", 2, None)], "gene string, fold int, x double")
    W.table(df, f"{tmp_path}/t", ["fold"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    more = df.unionByName(spark.createDataFrame([("c", 3, 1.0)], df.schema))
    assert [r.gene for r in W.resumed(more, f"{tmp_path}/t", ["fold"]).collect()] == ["c"] and W.resumed(more, f"{tmp_path}/none", ["fold"]).count() == 3
    assert r"b\_\& & 2 &  \\" in W.latex(df.orderBy("gene"), "Cap", "tab:x")
    with pytest.raises(ValueError, match="rows"):
        W.latex(spark.range(300), "c", "l")
    assert "== s ==" in W.report({"s": df})
    W.gene_list(df, f"{tmp_path}/l")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/l").collect()) == ["a", "b_&"]


def test_incremental_ingest(spark, tmp_path):
    src, target, ck = (f"{tmp_path}/{x}" for x in ("src", "target", "ck"))
    for i in range(2):
        spark.range(3).withColumn("fold", F.lit(i)).write.mode("append").parquet(src)
        ingest_new(spark, src, "id long, fold int", target, ck, ["fold"]).awaitTermination(60)
        assert spark.read.parquet(target).count() == 3 * (i + 1)
