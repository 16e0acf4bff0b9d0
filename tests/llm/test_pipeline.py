"""The pipeline's stages, each against what it must do to its own input."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402
from evistrata.llm import queries, sentencepiece_codec  # noqa: E402
from evistrata.llm._shared import materialise, table  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_columns_and_rows(steps):
    for before in steps[:-1]:
        assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert steps[-1].count() == steps[-2].count() > 0


def test_language_keeps_texts_with_letters(steps):
    kept = {r.doc_id: r.text for r in steps[1].collect()}
    assert kept == {r.doc_id: r.text for r in steps[0].collect() if re.search(r"[^\W\d_]", r.text or "")}


def test_lines_only_lose(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    after = {r.doc_id: r.text for r in steps[2].collect()}
    assert before.keys() == after.keys()
    for i, text in after.items():
        rest = iter(before[i].split("\n"))
        assert all(line in rest for line in text.split("\n"))


def test_one_of_each_group(steps):
    from tests.llm.test_documents import brute_components

    texts = {r.doc_id: r.text or "" for r in steps[2].collect()}
    found = brute_components(texts, P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
    assert {r.doc_id for r in steps[3].collect()} == {d for d, (_, low) in found.items() if low == d}


def test_mix_repeats_whole_documents(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = [(r.doc_id, r.text) for r in steps[4].collect()]
    assert all(before[i] == t for i, t in after)
    assert max(np.unique([i for i, _ in after], return_counts=True)[1]) <= 3


def test_encoding_decodes(steps):
    back = sentencepiece_codec.decode(steps[5], queries.tokenizer_path("piece_bpe_32k.model"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in steps[4].collect()}


def test_one_stays_of_documents_under_shared_ids(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta"
    other = "one two three four five six seven eight nine"
    rows = [(3, same), (7, same), (7, other), (None, same), (None, other + " ten"), (None, "quite another text of some words here"), (4, None), (5, " "), (3, same)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.one_of_similar(spark, df, "").collect()]
    want = [(3, same), (3, same), (7, other), (None, rows[5][1]), (4, None), (5, " ")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_the_line_stage_drops_what_recurs(steps):
    from tests.llm.test_documents import brute_lines

    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert {r.doc_id: r.text for r in steps[2].collect()} == dict(brute_lines(before, P.MOSTLY))


def test_tables_of_a_stage_are_deleted(spark, sf_dir, monkeypatch):
    from evistrata.llm import _shared

    made = []
    monkeypatch.setattr(_shared, "_made", made)
    P.run(spark, sf_dir).count()
    assert len([x for x in made if "mix_sources" in x]) == 1 and len(made) <= len(P.STAGES)


def test_run_on_awkward_rows(spark, tmp_path):
    from tests.llm.test_documents import AWKWARD, SCHEMA

    rows = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "'x' AS label", "0.5 AS score", "'y' AS lang_pred", "1 AS size")
    for at, df in (("some", rows), ("none", rows.limit(0))):
        df.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        P.run(spark, f"{tmp_path}/{at}").collect()


def test_stages_delete_what_earlier_ones_left_but_not_what_is_read(spark, sf_dir, tmp_path):
    """Stages called one by one, as a driver does: their tables on the way go, also where the results are not written."""
    import corpus_pipeline
    from evistrata.llm._shared import _made, mark

    begin = mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    (_, language), (_, lines), (_, join) = corpus_pipeline.STAGES[:3]
    language(spark, docs, sf_dir).write.parquet(str(tmp_path / "0"))
    assert len(_made) > begin
    lines(spark, spark.read.parquet(str(tmp_path / "0")), sf_dir).write.parquet(str(tmp_path / "1"))
    first = set(_made[begin:])
    join(spark, spark.read.parquet(str(tmp_path / "1")), sf_dir).write.parquet(str(tmp_path / "2"))
    assert not first & set(_made)
    chained = join(spark, lines(spark, language(spark, docs, sf_dir), sf_dir), sf_dir)
    assert sorted(r.doc_id for r in chained.collect()) == sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).collect())


def test_only_places_of_listed_shingles_are_shuffled_with_sketches(spark):
    from evistrata.llm import ngram_join as N

    groups = spark.createDataFrame([(k, 9, [1000 * k, 1000 * k + 1, 7], [k] * 16) for k in range(1, 4)], "group_key long, n long, prefix array<long>, sketch array<long>")
    listed = spark.createDataFrame([(7,)], "shingle long")
    marks = spark.sparkContext.broadcast(N._bitmap(listed, "shingle"))
    found = groups.mapInArrow(N._postings(marks), N.POSTING).collect()
    assert sorted((r.shingle, r.group_key, r.n, r.pos, r.sketch == [r.group_key] * 16) for r in found if r.shingle == 7) == [(7, k, 9, 2, True) for k in range(1, 4)]
    assert len(found) == 3


def test_texts_that_stay_for_sure_are_not_shuffled(spark, sf_dir, monkeypatch):
    """Of near copies one stays, as a plain join gives it; the filter of hashes leaves few texts to that join."""
    import corpus_pipeline as C
    from evistrata.llm import ngram_join as N

    kept, words = [], [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:59] + [f"x{k}"])) for k in range(4)] + [(None, " ".join(words))] + [(10 + k, " ".join(f"{k}v{j}" for j in range(30))) for k in range(40)] + [(99, None), (98, "")]
    monkeypatch.setattr(N, "hash_filter", lambda keys, name, real=N.hash_filter: kept.append(real(keys, name)) or kept[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = C.one_of_similar(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in found.collect()) == [0, *range(10, 50), 98, 99]
    assert 4 <= docs.filter(kept[0](F.xxhash64(F.coalesce("text", F.lit(""))))).count() < 12
