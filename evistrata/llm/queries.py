"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evistrata.llm import exact_dedup, infill, language_id, license_rules, license_scan, line_dedup, media, merkle, mixing, ngram_join, secret_scan, sentencepiece_codec, substring_dedup, token_files
from evistrata.llm._shared import table

#: The id that ends a document in the token files.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents"), seed=7, rate=100, suffix_first=50)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


#: Line dedup over a table ``input_documents``: each document's lines and the places of dropped ones.
LINES_SQL = r"""
lines AS (
  SELECT doc_id, text, spot, line, len(tokens) AS n_tokens,
         array_to_string(list_transform(tokens[1:5], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS lead, tokens
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS tokens FROM (
    SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS spot FROM input_documents))
  WHERE len(tokens) >= 4),
leaves AS (SELECT n_tokens, lead FROM lines GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT DISTINCT n_tokens, lead, line, tokens, doc_id FROM lines SEMI JOIN leaves USING (n_tokens, lead)),
distinct_lines AS (SELECT n_tokens, lead, line, tokens, count(*) AS docs FROM inside GROUP BY ALL),
places AS (SELECT n_tokens, lead, line, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM distinct_lines),
supports AS (SELECT *, sum(docs) OVER (PARTITION BY n_tokens, lead, place, token) >= 10 AS fixed FROM places),
parsed AS (
  SELECT n_tokens, lead, line, string_agg(CASE WHEN fixed THEN token ELSE '<*>' END, ' ' ORDER BY place) AS template
  FROM supports GROUP BY ALL HAVING count(*) FILTER (WHERE fixed) >= 0.5 * n_tokens),
recurring AS (
  SELECT lead, template FROM parsed JOIN inside USING (n_tokens, lead, line) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
found AS (SELECT DISTINCT line FROM parsed SEMI JOIN recurring USING (lead, template)),
hits AS (SELECT doc_id, list(spot) AS dropped FROM lines SEMI JOIN found USING (line) GROUP BY doc_id),
deduped AS (
  SELECT d.*, string_split(coalesce(text, ''), chr(10)) AS split, dropped
  FROM input_documents d LEFT JOIN hits h ON d.doc_id = h.doc_id)
"""

OP2_SQL = (
    "WITH input_documents AS (SELECT doc_id, text FROM documents),"
    + LINES_SQL
    + r"""
SELECT doc_id, CAST(len(split) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(split, lambda x, i: dropped IS NULL OR NOT list_contains(dropped, i)), chr(10))) AS kept_sha256
FROM deduped
"""
)

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15)) AS BIGINT) >> 30 AS hash
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 3 AS cap FROM totals),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, arg_min(level, cap / weight) FILTER (WHERE level * weight <= cap) OVER () * weight) AS target FROM leveled),
plans AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3) AS whole FROM targets),
running AS (
  SELECT s.*, p.source_size, p.target, p.whole, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) > p.target - p.whole * p.source_size AS beyond
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN NOT beyond AND whole < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept, sha256(norm) AS text_sha256
FROM n
"""

#: A checksum's lowest bit, by eight steps a digit.
CRC_EVEN = """(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) & 1) = 1"""


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


OP11_SQL = (
    f"""
WITH RECURSIVE chosen AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, CASE WHEN {CRC_EVEN} THEN replace(text, chr(10), '') ELSE text END AS seen,
         {' || '.join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head FROM documents),
leaves AS MATERIALIZED (
  SELECT rid, doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("seen")}) AS seen_leaf FROM chosen),"""
    + r"""
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n),
runs AS MATERIALIZED (SELECT source, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM nodes WHERE n > 1 GROUP BY ALL),
subroots AS MATERIALIZED (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
top_runs AS MATERIALIZED (SELECT level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM tops WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT rid, source, 0 AS level, pos, n, seen_leaf AS acc, '' AS siblings FROM placed
  UNION ALL
  SELECT c.rid, c.source, c.level + 1, c.pos // 3, (c.n + 2) // 3,
         sha256(array_to_string(r.nodes[1:c.pos % 3], '') || c.acc || array_to_string(r.nodes[c.pos % 3 + 2:], '')),
         c.siblings || array_to_string(r.nodes[1:c.pos % 3], '') || array_to_string(r.nodes[c.pos % 3 + 2:], '')
  FROM climb c JOIN runs r ON r.source IS NOT DISTINCT FROM c.source AND r.level = c.level AND r.run = c.pos // 3 WHERE c.n > 1),
arrived AS MATERIALIZED (SELECT c.rid, s.subroot, s.pos, s.n, c.acc, c.siblings FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1),
last_climb AS (
  SELECT rid, 0 AS level, pos, n, acc, siblings FROM arrived
  UNION ALL
  SELECT c.rid, c.level + 1, c.pos // 3, (c.n + 2) // 3,
         sha256(array_to_string(r.nodes[1:c.pos % 3], '') || c.acc || array_to_string(r.nodes[c.pos % 3 + 2:], '')),
         c.siblings || array_to_string(r.nodes[1:c.pos % 3], '') || array_to_string(r.nodes[c.pos % 3 + 2:], '')
  FROM last_climb c JOIN top_runs r ON r.level = c.level AND r.run = c.pos // 3 WHERE c.n > 1)
SELECT p.doc_id, p.leaf, a.subroot, t.node AS root, sha256(l.siblings) AS proof_sha256, l.acc AS folded_root, l.acc = t.node AS verified
FROM placed p JOIN arrived a USING (rid) JOIN last_climb l ON l.rid = p.rid AND l.n = 1 CROSS JOIN (SELECT node FROM tops WHERE n = 1) t
"""
)

def _quoted(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _rows(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)


_SPACED = license_scan.spaced
OP13_SQL = (
    f"""
WITH rules(rule, label, priority, confidence, keyword, pattern) AS (
  VALUES {_rows([(i, r.label, r.priority, license_rules.CONFIDENCE[r.priority], _SPACED(r.keyword), f" ({_SPACED(r.pattern)}) ") for i, r in enumerate(license_rules.RULES)])}),
phrases(phrase, base_label) AS (VALUES {_rows([(f" {_SPACED(p)} ", label) for p, label in license_scan.BASE.items()])}),"""
    + r"""
plain AS (
  SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS inner_text FROM documents),
lows AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN inner_text = '' THEN '' ELSE ' ' || inner_text || ' ' END AS low FROM plain),
marked AS (
  SELECT rid, rule, label, priority, confidence, string_split(trim(regexp_replace(low, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS words
  FROM lows JOIN rules ON contains(low, keyword) AND regexp_matches(low, pattern)),
hits AS MATERIALIZED (
  SELECT rid, rule, label, priority, confidence, unnest(list_filter(list_transform(words, lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END), lambda i: i IS NOT NULL)) AS a,
         unnest(list_filter(list_transform(words, lambda w, i: CASE WHEN ends_with(w, chr(2)) THEN i END), lambda i: i IS NOT NULL)) AS b FROM marked),
stay AS (
  SELECT * FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits g WHERE g.rid = h.rid AND g.a <= h.a AND g.b >= h.b
      AND (g.priority > h.priority OR g.priority = h.priority AND (g.b - g.a > h.b - h.a OR g.b - g.a = h.b - h.a AND g.rule < h.rule)))),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(confidence) AS surest FROM stay GROUP BY rid),
based AS (
  SELECT rid, unnest(list_filter(list_transform(string_split(trim(regexp_replace(low, phrase, ' ' || chr(1) || ltrim(phrase), 'g')), '  '), lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END), lambda i: i IS NOT NULL)) AS a,
         base_label FROM lows JOIN phrases ON contains(low, phrase)),
base AS (SELECT rid, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, list(DISTINCT base_label) AS labels FROM based GROUP BY rid)
SELECT doc_id, CAST((length(low) - length(replace(low, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CAST(greatest(coalesce(surest, 0), CASE WHEN n_base > 0 THEN 0.6 ELSE 0 END) AS DOUBLE) AS score
FROM lows LEFT JOIN base b USING (rid) LEFT JOIN more m USING (rid)
"""
)

OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cut AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_media_columns": op4_media_columns,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_mix_sources": op6_mix_sources,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_language_id": op9_language_id,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op6_mix_sources": OP6_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
        "op13_license_scan": OP13_SQL,
    }
