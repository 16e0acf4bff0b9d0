"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: by its token count, then by its leading tokens, where
tokens with digits are one variable. Only leaves that enough lines reach are looked into.
There a token is constant at its place if enough documents have it, and else a variable field; the
line with its variables masked is its template. Templates that recur in enough documents, and are
constant for the most part, are boilerplate, and their lines are dropped from every document.

Lines, leaves, documents and templates are known by 128-bit hashes, and only those are shuffled.
A line that enough documents have whole is its own template; the texts of lines are fetched, once
for each distinct line, only in leaves that also hold rarer lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import WORD, clean, discard, materialise, text_or_empty

#: Leading tokens in the tree, documents that make a template recur, tokens and constant share it needs.
DEPTH, MIN_DOCS, MIN_TOKENS, MIN_CONSTANT = 5, 10, 4, 0.5
VARIABLE = "<*>"
LEAF, LINE, DOC = ("leaf1", "leaf2"), ("h1", "h2"), ("d1", "d2")


def _hashes(names: tuple[str, str], *cols: Column) -> list[Column]:
    """Two 64-bit hashes of the columns."""
    return [F.xxhash64(*cols).alias(names[0]), F.xxhash64(F.lit(1), *cols).alias(names[1])]


def _tokens(line: Column) -> Column:
    """Words of a line without line breaks."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def document_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(d1, d2, text) to the lines long enough: document, place, tokens, leaf and line hashes, and the line."""
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    counted = lines.withColumn("tokens", _tokens(F.col("line"))).withColumn("n_tokens", F.size("tokens")).filter(F.col("n_tokens") >= min_tokens)
    lead = F.regexp_replace(F.array_join(F.slice("tokens", 1, depth), " "), "[^ ]*[0-9][^ ]*", VARIABLE)
    return counted.select(*DOC, "at", "n_tokens", *_hashes(LEAF, F.col("n_tokens"), lead), *_hashes(LINE, F.col("line")), "line")


def _constants(rare: DataFrame, all_lines: DataFrame, min_docs: int, min_constant: float) -> DataFrame:
    """The template hash of each rare line that is constant for the most part: h1, h2, t1, t2."""
    place = F.posexplode(_tokens(F.col("line"))).alias("place", "token")
    support = all_lines.select(*LEAF, "docs", place).groupBy(*LEAF, "place", "token").agg(F.sum("docs").alias("support"))
    constant = materialise(support.filter(F.col("support") >= min_docs).withColumn("fixed", F.lit(True)).drop("support"), "template-constants")
    places = rare.select(*LINE, *LEAF, place).join(constant, [*LEAF, "place", "token"], "left")
    shown = F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise(VARIABLE).alias("token"))
    masked = places.groupBy(*LINE, *LEAF).agg(F.array_sort(F.collect_list(shown)).alias("shown"), F.count("fixed").alias("constants"))
    kept = masked.filter(F.col("constants") >= min_constant * F.size("shown"))
    return kept.select(*LINE, *_hashes(("t1", "t2"), *LEAF, F.array_join(F.transform("shown", lambda x: x["token"]), " ")))


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> tuple[DataFrame, DataFrame]:
    """The distinct lines whose template recurs (h1, h2), and the lines of leaves that enough lines reach."""
    reach = lines.groupBy(*LEAF).agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    leaves = materialise(reach.select(*LEAF), "template-leaves")
    inside = materialise(lines.select(*DOC, "at", "n_tokens", *LEAF, *LINE).join(leaves, [*LEAF], "left_semi"), "template-lines")
    # A document counts once for a line, and for a template, whichever of its lines have it.
    distinct = inside.select(*LEAF, *LINE, *DOC).distinct().groupBy(*LEAF, *LINE).agg(F.count("*").alias("docs"))
    distinct = materialise(distinct, "template-distinct")
    often, seldom = distinct.filter(F.col("docs") >= min_docs), distinct.filter(F.col("docs") < min_docs)
    wanted = materialise(distinct.join(seldom.select(*LEAF).distinct(), [*LEAF], "left_semi"), "template-mixed")
    texts = lines.select(*LINE, "line").join(wanted.select(*LINE), [*LINE], "left_semi").groupBy(*LINE).agg(F.first("line").alias("line"))
    texts = materialise(wanted.join(texts, [*LINE]), "template-texts")
    parsed = materialise(_constants(texts.filter(F.col("docs") < min_docs), texts, min_docs, min_constant), "templates")
    whole = texts.filter(F.col("docs") >= min_docs).select(*_hashes(("t1", "t2"), *LEAF, F.array_join(_tokens(F.col("line")), " "))).distinct()
    named = inside.select(*LINE, *DOC).join(parsed, [*LINE]).select("t1", "t2", *DOC).distinct()
    recurring = named.groupBy("t1", "t2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("t1", "t2").unionByName(whole).distinct()
    found = often.select(*LINE).unionByName(parsed.join(recurring, ["t1", "t2"], "left_semi").select(*LINE))
    return materialise(found, "templates-recurring"), inside


def drop_templates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_constant: float = MIN_CONSTANT, max_share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; ``text_col`` without boilerplate lines, and ``__dropped`` lines.

    Null texts stay null and empty ones empty. Lines of fewer than ``min_tokens`` tokens, blank
    ones among them, always stay. Rows repeated with id and text count as one document and are
    treated alike; documents under one id with different texts are told apart. A template with
    exactly ``min_docs`` documents, or exactly ``min_constant`` of its tokens constant, is dropped.

    With ``max_share``, a document that would lose more than this share of its words stays whole:
    so copies of a document are left to a stage for near copies and not emptied here.
    """
    keyed = docs.select("*", *_hashes(("__d1", "__d2"), F.col(id_col), text_or_empty(text_col)))
    lines = materialise(document_lines(keyed.select(F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), text_or_empty(text_col).alias("text")), depth, min_tokens), "lines")
    found, inside = recurring_lines(lines, min_docs, min_constant)
    hits = inside.select(*LINE, *DOC, "at", "n_tokens").join(found, [*LINE], "left_semi").select(*DOC, "at", "n_tokens").distinct()
    per_doc = hits.groupBy(F.col("d1").alias("__k1"), F.col("d2").alias("__k2")).agg(F.collect_list("at").alias("__at"), F.sum(F.col("n_tokens").cast("long")).alias("__words"))
    per_doc = materialise(per_doc, "lines-dropped")
    discard(lines, inside)
    clean(docs.sparkSession)
    split = keyed.withColumn(text_col, F.split(text_col, "\n", -1))
    joined = split.join(per_doc, (F.col("__d1") == F.col("__k1")) & (F.col("__d2") == F.col("__k2")), "left")
    some = F.col("__at").isNotNull()
    if max_share is not None:
        some &= F.col("__words") <= max_share * F.regexp_count(F.array_join(text_col, "\n"), F.lit(WORD))
    left = F.array_except(F.sequence(F.lit(0), F.size(text_col) - 1), F.col("__at"))
    rest = F.transform(left, lambda i: F.get(F.col(text_col), i))
    done = joined.withColumn("__dropped", F.when(some, F.size("__at")).otherwise(0))
    return done.withColumn(text_col, F.array_join(F.when(F.col("__dropped") > 0, rest).otherwise(F.col(text_col)), "\n")).drop("__d1", "__d2", "__k1", "__k2", "__at", "__words")


def line_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 (null text as empty)."""
    whole = docs.select("doc_id", text_or_empty().alias("text"))
    done = drop_templates(whole.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    return done.select("doc_id", "n_lines", F.col("__dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
