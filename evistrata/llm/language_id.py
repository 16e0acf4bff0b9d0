"""Language identification by word-first backoff.

A known word scores its smoothed log frequency in each language. An unseen word scores the mean
of its character n-grams' log frequencies, from the longest order of which any n-gram is known. A
text's language is the one with the largest sum over its words, and the score is that language's
share of the total probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise
from evistrata.llm._tasks import record, tidy
from evistrata.llm._words import SMALL_SLICE_BYTES, slices, split_words

#: Labelled texts to learn from, about; chosen by a hash of text and label.
SAMPLE_TEXTS = 10_000
#: Entries of the model: words, and n-grams of each order.
MODEL_WORDS, MODEL_GRAMS = 40_000, 15_000
LONGEST = 4
UNKNOWN = "und"

#: Unseen words kept with their scores by a worker.
MEMO_ENTRIES = 150_000


@dataclass
class Model:
    """Log frequencies: ``words`` with a row each in ``word_scores``, and n-grams by order."""

    languages: list[str]
    words: list[str]
    word_scores: np.ndarray
    grams: list[dict[str, np.ndarray]]


def _scores(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (totals + 0.5 * max(1, len(counts))))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``SAMPLE_TEXTS`` of the rows with a label; fewer rows are all used.

    Counts are made by Spark; only the most frequent words and n-grams, whose number is bounded,
    reach the driver. Null labels and texts are not used; without any row there is no language.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    total = rows.count()
    if total > SAMPLE_TEXTS:
        rows = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 52)) < (1 << 52) * SAMPLE_TEXTS // total)
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("item")).filter("item <> ''").groupBy("lang", "item").agg(F.count("*").alias("n"))
    words = materialise(words, "language-words")
    padded = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    tables = [(words, MODEL_WORDS)]
    for order in range(1, LONGEST + 1):
        places = F.when(F.length(padded) >= order, F.sequence(F.lit(1), F.length(padded) - order + 1)).otherwise(F.array().cast("array<int>"))
        grams = words.select("lang", "n", F.explode(F.transform(places, lambda i, k=order: F.substring(padded, i, k))).alias("item"))
        tables.append((grams.groupBy("lang", "item").agg(F.sum("n").alias("n")), MODEL_GRAMS))
    languages = [r[0] for r in words.groupBy("lang").count().orderBy("lang").select("lang").collect()]
    parts = []
    for counts, most in tables:
        of = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(languages)]
        found = counts.groupBy("item").agg(F.sum("n").alias("n"), *of).orderBy(F.desc("n"), "item").limit(most).drop("n").toPandas()
        table = found.drop(columns="item").to_numpy(float).reshape(len(found), len(languages))
        parts.append((found["item"].tolist(), _scores(table, table.sum(axis=0))))
    return Model(languages, *parts[0], [dict(zip(*x)) for x in parts[1:]])


def _unseen(word: str, grams: list[dict[str, np.ndarray]], none: np.ndarray) -> np.ndarray:
    padded = f"<{word}>"
    for order in range(LONGEST, 0, -1):
        table = grams[order - 1]
        known = [table[g] for i in range(len(padded) - order + 1) if (g := padded[i : i + order]) in table]
        if known:
            return np.mean(known, axis=0)
    return none


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) for every whole text, and a struct ``kept`` of the columns in ``keep``.

    ``und`` with score 0 where the text is null or has no letters, or nothing was learned. Equal
    sums go to the first language in order. ``keep`` is empty or holds ``text_col``.
    """
    if keep and text_col not in keep:
        raise ValueError("keep must hold the text column")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    languages, none = model.languages, np.zeros(len(model.languages))
    memo: dict[str, np.ndarray] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        value_set = pa.array(known.words, pa.string())
        for batch in batches:
            texts = pc.fill_null(batch.column(1) if text_col not in keep else batch.column(1).field(keep.index(text_col)), "")
            for a, b in slices(texts, SMALL_SLICE_BYTES):
                lowered = pc.replace_substring_regex(pc.utf8_lower(texts.slice(a, b - a)), r"[^\pL]+", " ")
                offsets, words = split_words(lowered)
                coded = pc.dictionary_encode(words)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set), -1).to_numpy(zero_copy_only=False)
                table = known.word_scores[place] if len(known.words) else np.zeros((len(place), len(languages)))
                fresh = np.flatnonzero(place < 0)
                for i, word in zip(fresh, coded.dictionary.take(pa.array(fresh)).to_pylist()):
                    score = memo.get(word)
                    if score is None:
                        if len(memo) >= MEMO_ENTRIES:
                            memo.clear()
                        score = memo[word] = _unseen(word, known.grams, none)
                    table[i] = score
                of_word = table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros((0, len(languages)))
                sums = np.concatenate([np.zeros((1, len(languages))), np.cumsum(of_word, axis=0)])
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                empty = (np.diff(offsets) == 0) | (not languages)
                best = total.argmax(axis=1) if languages else np.zeros(b - a, np.int64)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(b - a)
                names = [UNKNOWN if e else languages[k] for e, k in zip(empty, best)]
                rest = {"kept": batch.column(1).slice(a, b - a)} if text_col in keep else {}
                yield record(id=batch.column(0).slice(a, b - a), lang_pred=pa.array(names, pa.string()), score=np.where(empty, 0.0, share), **rest)

    whole = F.struct(*keep).alias("kept") if text_col in keep else F.col(text_col)
    schema = "id long, lang_pred string, score double" + (f", kept {dict(docs.select(whole).dtypes)['kept']}" if text_col in keep else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), whole).mapInArrow(tidy(rows), schema).withColumnRenamed("id", id_col)


def held_out(col: str = "doc_id") -> Column:
    """Documents to test on: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from documents with an id that are not held out, predict for all: doc_id, held_out, lang_pred, score.

    Neither label nor id nor any other column is an input of a prediction. Rows repeated with an
    id keep their own results.
    """
    model = learn(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "lang_pred", "score")
