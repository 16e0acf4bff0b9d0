"""Merkle manifest, fill-in-middle and license scan: against plain versions, and by value on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evistrata.llm import infill, license_scan, merkle, queries
from evistrata.llm._shared import table
from evistrata.llm.license_rules import CONFIDENCE, RULES, TAG, Rule, gate_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Alpha\nbeta MIT License.\n\nend", "en", "a", 30),
    (1, "Alpha\nbeta MIT License.\n\nend", "en", "a", 30),
    (1, "a second text under one id\n", None, "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "fr", None, 5),
    (None, "Apache  License\nApache License", None, "b", None),
    (None, "no id either\n", "de", "b", 1),
    (5, "word \n" * 3000, "de", "b", 18000),
    (6, "é ü 日本 😀 x\x00y CC-BY", "fr", "c", 12),
    (8, "holds <P> already\n", "en", "ü", 18),
    (9, "\n\n\n", "en", "", 3),
    (-7, "negative\nid", "en", "😀", 11),
]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=3):
    """Rows (doc_id, leaf, subroot, root, proof, folded root, verified), with whole trees in lists."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc, text, lang, source, n in rows:
        own = lambda t, d=doc, s=source, l=lang, c=n: digest(*map(shown, (d, s, l, c, t)))  # noqa: E731, E741
        cut = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        by.setdefault(source, []).append((doc is not None, doc or 0, own(text), own(cut)))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, i in zip(paths, at):
                begin = i // arity * arity
                path.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + arity])))
            nodes, at = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
        return nodes[0], paths

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    root, tops = tree([below[s][0] for s in sources]) if sources else (None, [])
    out = Counter()
    for source, top in zip(sources, tops):
        for (there, doc, leaf, seen), path in zip(sorted(by[source]), below[source][1]):
            node = seen
            for before, after in path + top:
                node = digest(before, node, after)
            out[doc if there else None, leaf, below[source][0], root, digest(*(b + a for b, a in path + top)), node, node == root] += 1
    return out


@pytest.mark.parametrize("block_levels", [1, 2, 5])
def test_manifest(spark, sf_dir, block_levels):
    made = spark.createDataFrame(ROWS * 3, SCHEMA).selectExpr("*", "1 AS node", "2 AS place", "'x' AS leaf2", "3 AS n", "4 AS block", "5 AS root")
    for docs in (table(spark, sf_dir, "documents"), made):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        got = Counter(map(tuple, merkle.verified_manifest(docs, block_levels=block_levels).collect()))
        assert got == brute_manifest(rows)
        assert 0 < sum(n for r, n in got.items() if r[-1]) < len(rows)
    assert merkle.verified_manifest(made.limit(0), block_levels=block_levels).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 82])
def test_manifest_of_one_source_and_of_many(spark, n):
    for rows in ([(i, f"t{i}\n", None, None, i) for i in range(n)], [(i, "same\n", "x", f"s{i:03}", 5) for i in range(n)]):
        assert Counter(map(tuple, merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA), block_levels=1).collect())) == brute_manifest(rows)


def test_other_columns_and_arity(spark):
    rows = spark.createDataFrame([(i % 3, i // 3, f"v{i}") for i in range(40)], "site int, number int, value string")
    leaves = rows.withColumn("leaf", merkle.leaf_of(("site", "number", "value")))
    got = merkle.manifest(leaves, "site", ("number",), ("value",), arity=4, block_levels=2).collect()
    assert len(got) == 40 and len({r.root for r in got}) == 1
    for r in got:
        node = digest(*(f"{len(str(v))}:{v}" for v in (r.source, r.number, r.value)))
        assert node == r.leaf
        for step in r.path:
            node = digest(step.before, node, step.after)
        assert node == r.root


def brute_infill(doc, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc, len(lines), "plain", None, None, text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, len(lines), form, len(p), len(m), out)


def test_infill(spark, sf_dir):
    made = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS output", "2 AS h1", "3 AS n", "'q' AS form")
    for docs in (table(spark, sf_dir, "documents"), made):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        want = [brute_infill(*r) for r in rows]
        assert Counter(map(tuple, infill.fill_in_middle(docs).collect())) == Counter(want)
        sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
        assert Counter(map(tuple, infill.infill_report(docs).collect())) == Counter((*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(want, rows))
    assert infill.infill_report(made.limit(0)).count() == 0


def test_rates_of_forms(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree") for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in infill.fill_in_middle(docs, seed=1, rate=50, suffix_first=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260
    back = infill.restore(infill.fill_in_middle(docs, seed=3, rate=80)).collect()
    assert {r.restored for r in back} == {"one\ntwo\nthree"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n<PSM>é😀 ", max_size=60), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from([1, 2, 3, 7, 2048]))
def test_ropes(text, draws, size):
    n, form, first, middle, output = infill.rearranged(text, draws, size=size)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert n == len(lines) and infill.restored(output, form, size) == text
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    if form != infill.PLAIN:
        assert (first, middle) == (len("".join(lines[:a])), len("".join(lines[a:b])))
    tree = infill.rope(text, size)
    for k in range(n + 1):
        assert infill.chars_before(tree, k) == len("".join(lines[:k]))


def test_ropes_stay_flat():
    tree = infill.EMPTY
    for _ in range(4000):
        tree = infill.join(tree, infill.leaf("x\n"))
    assert tree.height <= 18 and tree.units == 4000 and infill.flat(tree) == "x\n" * 4000


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(text, rules=RULES):
    """Facts and detections (start, end, label, confidence), each rule on the words, each pair of detections compared."""
    words = plain_words(text)
    base = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    begins, joined = {}, ""
    for i, w in enumerate(words):
        begins[len(joined) + (1 if joined else 0)] = i
        joined += " " + w if joined else w
    found = []
    for k, rule in enumerate(rules):
        at = 0
        pattern = re.compile(f"(?<![^ ]){rule.pattern}(?![^ ])")
        while m := pattern.search(joined, at):
            found.append((begins[m.start()], begins[m.start()] + len(m[0].split()), -rule.priority, k, rule.label, CONFIDENCE[rule.priority]))
            at = m.end() + 1 if m.end() < len(joined) else m.end()
            if at >= len(joined):
                break
    inside = lambda h, g: g[0] <= h[0] and g[1] >= h[1] and (g[2] < h[2] or g[2] == h[2] and (g[1] - g[0], -g[3]) > (h[1] - h[0], -h[3]))
    stay = [h for h in found if not any(inside(h, g) for g in found)]
    labels = sorted({x for _, x in base})
    places = [i for i, _ in base]
    score = max([h[5] for h in stay] + [license_scan.BASE_CONFIDENCE if base else 0.0, 0.0])
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(labels), ",".join(sorted({*labels, *(h[4] for h in stay)})), score), sorted((h[0], h[1], h[4], h[5]) for h in stay)


LICENSE_TEXTS = [
    "MIT License MIT License mit license",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X)",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. See https://creativecommons.org/licenses/by-sa/4.0/",
    "GNU Lesser General Public License v2.1, the gnu general public license version 3 or later; GPLv3+; LGPL 3.0",
    "mit Lizenz und mit licensee; apache licensed; emit license; limit license",
    "cc by cc by-nc 3.0 CC0 1.0 Universal, all rights reserved. Copyright (c) 2021 by X",
    "Kelvin Kİ apache license apache\x01license \x02mit\x01\x02license",
    "prose without any of it, and a long tail " * 50,
    "mit license " * 3000,
]


def test_scan_against_a_plain_one(spark, sf_dir):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSE_TEXTS)] + [(r[0], r[1]) for r in ROWS], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS found", "3 AS label")
    for docs in (table(spark, sf_dir, "documents"), made):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            if len(r.text or "") < 30_000 or docs is not made:
                facts, _ = brute_scan(r.text)
                want[r.doc_id, *facts] += 1
        got = Counter(tuple(r)[:8] for r in license_scan.scan_licenses(docs).collect())
        assert {k: n for k, n in got.items() if k[1] < 5000} == {k: n for k, n in want.items() if k[1] < 5000}
    assert license_scan.scan_licenses(made.limit(0)).count() == 0
    long = [r for r in license_scan.scan_licenses(made).collect() if r.n_words == 6000][0]
    assert (long.n_base, long.first_word, long.last_word, long.base_labels, long.labels, len(long.detections)) == (3000, 0, 5998, "mit", "mit", 5999)  # "mit license" and, between two of them, "license mit"


def test_suppression(spark):
    rng = random.Random(3)
    rules = [Rule(f"l{i}", rng.choice(list(CONFIDENCE)), "k", "k") for i in range(12)]
    rows = [(i % 9, rng.randrange(12), a := rng.randrange(30), a + rng.randint(1, 9)) for i in range(400)]
    rows = list(dict.fromkeys(rows))
    inside = lambda h, g: g[2] <= h[2] and g[3] >= h[3] and (rules[g[1]].priority > rules[h[1]].priority or rules[g[1]].priority == rules[h[1]].priority and (g[3] - g[2], -g[1]) > (h[3] - h[2], -h[1]))
    want = sorted(h for h in rows if not any(g[0] == h[0] and inside(h, g) for g in rows))
    got = license_scan.kept_detections(spark.createDataFrame(rows, "row long, rule int, start int, end int"), "row", rules).select("row", "rule", "start", "end").collect()
    assert sorted(map(tuple, got)) == want


def test_rules_are_many():
    assert len(RULES) >= 300 and len({r.label for r in RULES}) >= 100 and TAG == max(CONFIDENCE)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.label)
@settings(max_examples=8, deadline=None, database=None)
@given(data=st.data())
def test_a_match_holds_its_keyword_and_gate(rule, data):
    text = data.draw(st.from_regex(re.compile(rule.pattern.replace("[^ ]", "[a-z]")), fullmatch=True))
    assert rule.keyword in text and gate_of(rule) in f" {text} " and "  " not in f" {text} "


@pytest.mark.parametrize(("text", "label"), [
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"), ("Mozilla Public License, v. 2.0", "mpl-2.0"), ("released into the public domain", "public-domain"),
    ("see http://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"), ("SPDX-License-Identifier: EUPL-1.2", "eupl-1.2"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("BSD 3-Clause License", "bsd-3-clause"),
])
def test_labels(spark, text, label):
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in got.labels.split(",") and got.score > 0


def test_rules_keep_prose_clean(spark):
    prose = ["Er kam mit dem Zug, mit Lizenz zum Bauen.", "The committee shall permit public hardware.", "Limits apply; the artist's right to roam.", "Je suis en retard, aware of the terms."]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")).collect()
    assert {(r.labels, r.score) for r in got} == {("", 0.0)}


def test_no_python_in_the_license_scan(spark, sf_dir):
    plan = queries.queries()["op13_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
