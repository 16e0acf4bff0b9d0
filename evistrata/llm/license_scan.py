"""License scan: ordered signature rules over words, in DataFrame functions alone.

A text becomes its words in lower case, two blanks between, one at each end, so that matches that
follow each other share no blank. A rule is tried where the text holds its keyword; its matches are
marked in the text, and the words that carry marks are the detections' intervals. Of overlapping
detections one that lies within another's interval is suppressed when the other has the higher
priority, or the same one and is longer or stands earlier in the rules.

The texts are read once and not shuffled; only the detections (words, rule) are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise, text_or_empty
from evistrata.llm.license_rules import CONFIDENCE, RULES, Rule, gate_of

#: Phrases that always count, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEGIN, END = "\x01", "\x02"


def spaced(pattern: str) -> str:
    """A pattern over words with one blank between, for texts with two."""
    return pattern.replace(" ?", "(?: )?").replace(" ", "  ")


BASE_PATTERN = f" (?:{'|'.join(spaced(p) for p in BASE)}) "


def spaced_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower case, each between blanks of its own."""
    inner = F.trim(F.regexp_replace(text, SEPARATORS, "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), F.lower(inner), F.lit(" ")))


def n_words_of(part: Column) -> Column:
    """Words of a piece of such a text; every word has two blanks."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" ")))) / 2).cast("long")


def _literal(rows: list[dict], kind: str) -> Column:
    """A constant array of structs, from JSON: one node of the plan however many rows."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def grouped(rules: list[Rule]) -> Column:
    """The rules as one constant: gates, the keywords under each, and the number and marked pattern of each keyword's rules."""
    by: dict[str, dict[str, list[dict]]] = {}
    for i, rule in enumerate(rules):
        gate = gate_of(rule)
        by.setdefault(gate.replace(gate.strip(), spaced(gate.strip())), {}).setdefault(spaced(rule.keyword), []).append({"rule": i, "pattern": f" ({spaced(rule.pattern)}) "})
    rows = [{"gate": g, "keywords": [{"keyword": k, "rules": v} for k, v in under.items()]} for g, under in by.items()]
    return _literal(rows, "struct<gate:string,keywords:array<struct<keyword:string,rules:array<struct<rule:int,pattern:string>>>>>")


def _marked_words(low: Column, pattern: Column) -> Column:
    marks = F.regexp_replace(low, pattern, F.lit(f" {BEGIN}$1{END} "))
    return F.split(F.trim(marks), "  ", -1)


def detections(low: Column, rules: list[Rule] = RULES) -> Column:
    """All matches of all rules in a text of ``spaced_words``: array of (rule, start, end), words from 0, end exclusive."""

    def places(words: Column, mark: str, found: Column) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(found(w), i)), lambda i: i.isNotNull())

    def of_rule(r: Column) -> Column:
        pairs = F.transform(
            F.array(_marked_words(low, r["pattern"])),
            lambda words: F.arrays_zip(places(words, BEGIN, lambda w: w.startswith(BEGIN)).alias("start"), places(words, END, lambda w: w.endswith(END)).alias("last")),
        )
        return F.transform(pairs[0], lambda p: F.struct(r["rule"].alias("rule"), p["start"].alias("start"), (p["last"] + 1).alias("end")))

    near = F.filter(grouped(rules), lambda g: F.contains(low, g["gate"]))
    there = F.filter(F.flatten(F.transform(near, lambda g: g["keywords"])), lambda k: F.contains(low, k["keyword"]))
    tried = F.filter(F.flatten(F.transform(there, lambda g: g["rules"])), lambda r: F.rlike(low, r["pattern"]))
    return F.flatten(F.transform(tried, of_rule))


def kept_detections(found: DataFrame, key: str, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (key, rule, start, end) that no detection of their key suppresses, with label, priority and confidence.

    In order of start, then end from the last, what could hold a detection stands before it, so it
    is suppressed when the farthest end so far, among priorities of its own or above, reaches its end.
    """
    row = _literal([{"label": r.label, "priority": r.priority, "confidence": CONFIDENCE[r.priority]} for r in rules], "struct<label:string,priority:int,confidence:double>")
    named = found.withColumn("r", F.get(row, F.col("rule"))).select(key, "rule", "start", "end", "r.*")
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(CONFIDENCE)
    reach = named.withColumns({f"__reach{p}": F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in levels})
    own = F.coalesce(*(F.when(F.col("priority") == p, F.col(f"__reach{p}")) for p in levels))
    return reach.filter(F.coalesce(own < F.col("end"), F.lit(True))).drop(*(f"__reach{p}" for p in levels))


def scan_licenses(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``labels`` joins those of the base phrases and of the detections that stay; ``score`` is the
    confidence of the surest. ``detections`` are (start, end, label, confidence) in order. A null
    text counts as empty: no words, null places, empty labels, score 0. Repeated rows give repeated
    results, ids may be null or shared; other columns are ignored.
    """
    low = docs.select(F.col(id_col).alias("doc_id"), spaced_words(text_or_empty(text_col)).alias("low"))
    parts = F.split("low", BASE_PATTERN, -1)
    matches = F.regexp_extract_all("low", F.lit(BASE_PATTERN), F.lit(0))
    facts = low.select(
        "doc_id",
        n_words_of(F.col("low")).alias("n_words"),
        F.regexp_count("low", F.lit(BASE_PATTERN)).cast("long").alias("n_base"),
        F.when(F.rlike("low", F.lit(BASE_PATTERN)), F.struct(n_words_of(parts[0]).alias("first"), (n_words_of(F.element_at(parts, -1)) + n_words_of(F.element_at(matches, -1))).alias("from_end"))).alias("edge"),
        F.array_compact(F.array(*(F.when(F.contains("low", F.lit(f" {spaced(p)} ")), F.lit(label)) for p, label in BASE.items()))).alias("base"),
        detections(F.col("low"), rules).alias("found"),
    )
    facts = materialise(facts.withColumn("row", F.monotonically_increasing_id()), "license-facts")
    stay = kept_detections(facts.select("row", F.explode("found").alias("x")).select("row", "x.*"), "row", rules)
    item = F.struct("start", "end", "label", "confidence")
    by_row = stay.groupBy(F.col("row").alias("of")).agg(F.collect_set("label").alias("more"), F.max("confidence").alias("surest"), F.sort_array(F.collect_list(item)).alias("detections"))
    joined = facts.drop("found").join(by_row, F.col("row") == F.col("of"), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        F.col("edge.first").alias("first_word"),
        (F.col("n_words") - F.col("edge.from_end")).alias("last_word"),
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", more)).alias("labels"),
        F.greatest(F.coalesce("surest", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        F.coalesce("detections", F.array().cast("array<struct<start:int,end:int,label:string,confidence:double>>")).alias("detections"),
    )
