"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Language id drops texts without letters, line dedup drops boilerplate lines, the n-gram join keeps
one document of each group of near copies, mixing takes documents by source weight, and the last
stage encodes what was taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.llm import language_id, line_dedup, mixing, ngram_join, sentencepiece_codec
from evistrata.llm._shared import materialise, mark, release, release_unread, table, text_or_empty, written_since
from evistrata.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: words in a shingle and percent of Jaccard similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: A document that would lose more than this share of its words to line dedup is a copy.
MOSTLY = 0.5


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is ``und``: null texts and texts without letters.

    Learns from the labelled documents of ``sf_dir``; all columns stay as they are, and ``lang``
    is kept as given. Repeated rows share their fate.
    """
    model = language_id.learn(table(spark, sf_dir, "documents"))
    found = language_id.predict(docs, model, keep=tuple(docs.columns)).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select("kept.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop recurring lines from the texts; every document stays, ``n_chars`` follows its text.

    A document mostly made of recurring lines is a copy; it stays whole for the next stage, which
    keeps one of each group of copies.
    """
    done = line_dedup.drop_templates(docs, max_share=MOSTLY)
    changed = F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id, then of a hash of the text.

    Documents without an id come after those with one. Rows repeated with id and text are one
    document and stay or go together; different texts under one id are different documents. Texts
    without words are not similar to anything and stay.
    """
    found = ngram_join.similar_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT).filter("component_key IS NOT NULL")
    found = materialise(found.select("doc_id", "text_key", "component_key").distinct(), "near-copies")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.groupBy(F.col("component_key").alias("__c")).agg(F.min(place).alias("__first"))
    lost = found.join(first, (F.col("component_key") == F.col("__c")) & (F.col("__first") != place)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    lost = materialise(lost, "near-copies-lost")
    key, maybe = F.xxhash64(text_or_empty()), ngram_join.hash_filter(lost, "__key")
    # Only texts that may go are shuffled to be compared.
    rest = docs.filter(maybe(key)).join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")
    return docs.filter(~maybe(key)).unionByName(rest)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by source weight; one taken twice or three times has as many rows.

    Documents without words have no size and are not taken.
    """
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: doc_id, n_pieces, ids, source, lang."""
    return sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("source", "lang"))


#: Folders that a stage has written on its way and that are still there, by the stage's place.
_left: dict[int, list[str]] = {}


def _in_place(place: int, stage: Stage) -> Stage:
    """``stage``, which first deletes what the stages before it have written on their way.

    What its own input still reads stays, so stages may also be chained without writing their results.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for before in range(place):
            _left[before] = release_unread(_left.get(before, []), docs)
        begin = mark()
        done = stage(spark, docs, sf_dir)
        _left[place] = _left.get(place, []) + written_since(begin)
        return done

    return run_stage


_IN_ORDER: list[tuple[str, Stage]] = [
    ("language_id", with_language),
    ("line_dedup", without_boilerplate),
    ("ngram_join", one_of_similar),
    ("mix_sources", mixed),
    ("sentencepiece", encoded),
]
STAGES: list[tuple[str, Stage]] = [(name, _in_place(k, stage)) for k, (name, stage) in enumerate(_IN_ORDER)]

#: No SQL: neither the language model's words nor the piece ids are within SQL's reach.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read by the next.

    What a stage has written on its way goes when its result is there.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begin = mark()
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
