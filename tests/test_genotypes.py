"""Packed genotypes against rows of single calls."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from evistrata.operators import causal as C
from evistrata.operators import genotypes as P
from evistrata.sources import readers as R


def made(spark, n_samples, n_snps, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{i:03}", f"v{j:02}", "A", "G", rng.choice([0.0, 1.0, 2.0, None])) for i in range(n_samples) for j in range(n_snps) if rng.random() < 0.9]
    weights = [(f"g{rng.randrange(5)}", f"v{j:02}", rng.choice("AGT"), rng.uniform(-1, 1)) for j in range(n_snps + 2) for _ in range(rng.randint(0, 3))]
    return spark.createDataFrame(rows, "sample string, snp string, ref string, alt string, dosage double"), spark.createDataFrame(weights, "gene string, snp string, allele string, weight double")


@pytest.mark.parametrize(("samples", "block"), [(37, 4096), (37, 8), (1, 4)])
def test_scores_and_round_trip(spark, samples, block, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", block)
    g, w = made(spark, samples, 23)
    index = P.sample_index(g)
    packed = P.pack(g, index)
    back = Counter(tuple(r) for r in P.unpack(packed, index).filter("dosage IS NOT NULL").collect())
    assert back == Counter(tuple(r) for r in g.filter("dosage IS NOT NULL").collect())
    want = {(r.sample, r.gene): (r.score, r.n_snps) for r in C.genotype_scores(g, w).collect()}
    got = {(r.sample, r.gene): (r.score, r.n_snps) for r in P.packed_scores(packed, w, index).collect()}
    assert set(got) == set(want) and all(got[k][0] == pytest.approx(v[0]) and got[k][1] == v[1] for k, v in want.items())
    assert P.packed_scores(packed, w.limit(0), index).count() == 0


def test_other_dosages_are_an_error(spark):
    g = spark.createDataFrame([("s", "v", "A", "G", 0.5)], "sample string, snp string, ref string, alt string, dosage double")
    with pytest.raises(Exception, match="a dosage is 0, 1 or 2"):
        P.pack(g, P.sample_index(g)).collect()


@pytest.mark.parametrize("n", [3, 4, 9])
def test_bed_files(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = random.Random(n)
    (tmp_path / "g.fam").write_text("".join(f"f{9 - i} i{i} 0 0 1 1\n" for i in range(n)))
    (tmp_path / "g.bim").write_text("".join(f"1 rs{j} 0 {100 + j} A C\n" for j in range(6)))
    (tmp_path / "g.bed").write_bytes(b"\x6c\x1b\x01" + bytes(rng.randrange(256) for _ in range(6 * -(-n // 4))))
    packed, index = R.plink_packed(spark, str(tmp_path / "g"))
    cols = ["sample", "snp", "ref", "alt", "dosage"]
    want = Counter(tuple(r) for r in R.plink(spark, str(tmp_path / "g")).select(*cols).collect())
    assert Counter(tuple(r) for r in P.unpack(packed, index).select(*cols).collect()) == want


def test_a_batch_is_multiplied_in_slices():
    """Calls are doubles in the product, so a large batch at once would take a multiple of its bytes."""
    import tracemalloc

    import pyarrow as pa

    n = 2_000
    kind = pa.list_(pa.struct([("gene", pa.string()), ("weight", pa.float64()), ("turned", pa.bool_())]))
    weights = pa.array([[{"gene": f"g{i % 3}", "weight": 1.0, "turned": False}] for i in range(n)], kind)
    calls = pa.array([bytes([0b10101010]) * (P.BLOCK // 4)] * n, pa.binary())  # one alternative allele each
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([0] * n, pa.int32()), calls, weights], names=["snp", "block", "calls", "weights"])
    total = {}
    tracemalloc.start()
    for out in P._products(iter([batch])):
        for g, v in zip(out.column("gene").to_pylist(), out.column("score")):
            total[g] = total.get(g, 0.0) + v.values[0].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == {f"g{j}": float(len(range(j, n, 3))) for j in range(3)}
    assert peak < 100_000_000


def test_batches_of_a_block_are_summed_in_the_task(monkeypatch):
    """Each batch handed on its genes' vectors of 64 KB, however few variants it had."""
    import pyarrow as pa

    monkeypatch.setattr(P, "PRODUCT", 2)
    kind = pa.list_(pa.struct([("gene", pa.string()), ("weight", pa.float64()), ("turned", pa.bool_())]))
    weights = pa.array([[{"gene": f"g{i % 3}", "weight": 1.0 + i, "turned": False}] for i in range(12)], kind)
    calls = pa.array([bytes([0b10101010]) * 2] * 12, pa.binary())  # one alternative allele each
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(12)]), pa.array([0] * 6 + [1] * 6, pa.int32()), calls, weights], names=["snp", "block", "calls", "weights"])

    def summed():
        rows = [r for out in P._products(iter([batch])) for r in out.to_pylist()]
        total = Counter()
        for r in rows:
            assert len(set(r["score"])) == len(set(r["n"])) == 1 and len(r["score"]) == 8
            total[r["gene"], r["block"]] += r["score"][0]
        return len(rows), total

    want = Counter()
    for i in range(12):
        want[f"g{i % 3}", i // 6] += 1.0 + i
    assert summed() == (6, want)
    monkeypatch.setattr(P, "HELD", 2)
    assert summed()[1] == want
