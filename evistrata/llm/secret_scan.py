"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags a line's tokens (words between white space) as secret begin, inside or outside. Its
features are a token's shape, size, digits and mixture of characters, the shapes and keywords of
both neighbours, and the file's length and share of tokens with digits. It is trained here by
gradient ascent on the likelihood; tags are decoded by Viterbi. A line is one sequence.

The base patterns label the lines to learn from. Besides its own form, a labelled line is also
learned with another keyword, with none, and with a secret of another alphabet or case, so that
shape and neighbours must carry what the patterns do not know.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise, text_or_empty
from evistrata.llm._tasks import concat_ranges, record
from evistrata.llm._words import slices, split_words

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Patterns that hold for every text with a base match; most texts have none.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
KINDS = ("assign", "access", "hex", "crf")

#: Distinct texts to train on: so many with a base match and so many without, of up to TRAIN_CHARS characters.
TRAIN_TEXTS, TRAIN_CHARS = 1000, 20_000
#: Of a text without a match, and of the lines far from one, every LINE_STEP-th line is learned, in pieces of PIECE tokens.
LINE_STEP, PIECE = 5, 100
#: Further forms that each line with a match is learned in.
FORMS = 4
EPOCHS, BATCHES, RATE, DECAY = 12, 20, 0.05, 1e-3
BITS = 14
OWN, FEATURES = 8, 14  # features of a token: its own, two of each neighbour, two of the file
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
KEYWORDS = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "key", "access", "credential", "auth", "bearer", "pwd", "login", "private")
#: Characters of the secrets in other forms.
ALPHABETS = (*(string.digits + x for x in ("abcdef", "ABCDEF", string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase, string.ascii_letters + "+/", string.ascii_letters + "_-")), string.ascii_letters)
HEXADECIMAL = set(string.hexdigits)
#: Tokens whose features a worker keeps, of up to 40 characters; they are the same for every field.
MEMO_ENTRIES = 150_000
_word = re.compile(r"[^ \t-\r]+")
_memo: dict[str, list[int]] = {}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, in code points, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if re.search("[0-9a-f]{24}", text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


@lru_cache(1 << 16)
def _hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << BITS) - 1)


class _Kinds(dict):
    """Code points to the kind of their character: 0, A, a, or the character itself."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[point]


_kinds = _Kinds()
_long_runs, _changes = re.compile(r"(.)\1{2,}", re.S), re.compile(r"(.)\1*", re.S)
_any_keyword = re.compile("|".join(KEYWORDS))


def _shape(token: str) -> str:
    """Kinds of a token's characters, at most two of a kind in a row."""
    return _long_runs.sub(r"\1\1", token[:64].translate(_kinds))[:12]


def _keyword(token: str) -> str:
    low = token.lower()
    return next(k for k in KEYWORDS if k in low) if _any_keyword.search(low) else ""


@lru_cache(1 << 16)
def _hashed_features(shape: str, word: str, last: str, size: int, kinds: str, digits: int, turns: int, hexadecimal: bool, distinct: int) -> tuple[list[int], list[int], list[int]]:
    own = [f"s{shape[:6]}", f"z{size}/{kinds}", f"d{digits}/{size}", f"k{word}/{last}", f"u{distinct}/{kinds}", f"t{turns}/{size}/{kinds}", f"h{int(hexadecimal)}/{size}/{digits > 0}", "b"]
    return [_hash(x) for x in own], [_hash(f"<{x}") for x in (f"s{shape[-3:]}", f"k{word}/{last}")], [_hash(f">{x}") for x in (f"z{size}/{kinds}", f"k{word}")]


def token_features(token: str) -> tuple[list[int], list[int], list[int]]:
    """Hashed features a token gives to itself, to the token behind it and to the one before it."""
    core = token.strip("\"'`,.;:()[]{}<>#*%&$")
    letters, last = set(core), token[-1:] if not token[-1:].isalnum() else "x"
    size, distinct = min(len(core) // 4, 10), min(len(letters) // 4, 6)
    if core.isalpha() and core.islower():  # most words of a text
        shape = ("aa" if len(core) > 1 else "a") if core == token else _shape(token)
        return _hashed_features(shape, _keyword(token), last, size, "a", 0, 0, letters <= HEXADECIMAL, distinct)
    seen = core[:64].translate(_kinds)
    kinds = "".join([k for k in "Aa0" if k in seen])
    digits = seen.count("0") * 5 // max(1, len(seen))
    turns = min((len(_changes.findall(seen)) - 1) * 8 // max(1, len(seen)), 6) if seen else 0
    return _hashed_features(_shape(token), _keyword(token), last, size, kinds, digits, turns, bool(core) and letters <= HEXADECIMAL, distinct)


def _remembered(token: str) -> list[int]:
    found = _memo.get(token)
    if found is None:
        found = [x for part in token_features(token) for x in part]
        if len(_memo) < MEMO_ENTRIES and len(token) <= 40:
            _memo[token] = found
    return found


def file_features(n_tokens: int, with_digits: int) -> list[int]:
    return [_hash(f"f{min(n_tokens, 1 << 16).bit_length()}"), _hash(f"g{min(9, with_digits * 50 // max(1, n_tokens))}")]


@dataclass
class Field:
    """Weights of hashed features by tag, and of tag pairs; a pair outside-inside is impossible."""

    weights: np.ndarray
    pairs: np.ndarray


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest on, and how many are that long at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -steps, "left")


def viterbi(emission: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best tags of every sequence at once, step by step over the sequences still running."""
    order, running = _layout(np.diff(offsets))
    starts = offsets[:-1][order]
    back = np.zeros((len(emission), 3), np.int8)
    tags = np.zeros(len(emission), np.int8)
    first = np.array([0.0, 0.0, -1e9])
    score = np.zeros((len(order), 3))
    for t, n in enumerate(running):
        at = starts[:n] + t
        if t == 0:
            score[:n] = emission[at] + first
            continue
        paths = score[:n, :, None] + pairs[None]
        back[at] = paths.argmax(axis=1)
        score[:n] = paths.max(axis=1) + emission[at]
    tag = score.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        state = tag[: running[t]]
        if t + 1 < len(running):
            going = running[t + 1]
            state[:going] = back[starts[:going] + t + 1, state[:going]]
        tags[starts[: running[t]] + t] = state
    return tags


def _gradients(field: Field, features: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log likelihood, by forward and backward passes over all sequences at once."""
    pairs, n = field.pairs, len(tags)
    order, running = _layout(lengths)
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[order]
    inner = np.ones(n, bool)
    inner[ends - lengths] = False
    emission = field.weights[features].sum(axis=1)
    forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
    for t, k in enumerate(running):
        at = starts[:k] + t
        forward[at] = emission[at] + (np.array([0.0, 0.0, -1e9]) if t == 0 else np.logaddexp.reduce(forward[at - 1][:, :, None] + pairs[None], axis=1))
    for t in range(len(running) - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        backward[at] = np.logaddexp.reduce(pairs[None] + (emission[at + 1] + backward[at + 1])[:, None, :], axis=2)
    both = forward + backward
    total = np.logaddexp.reduce(both, axis=1)[:, None]
    error = -np.exp(both - total)
    error[np.arange(n), tags] += 1
    flat = features.ravel()
    size = len(field.weights)
    grad = np.stack([np.bincount(flat, np.repeat(error[:, k], features.shape[1]), size) for k in range(3)], axis=1)
    at = np.flatnonzero(inner)
    joint = np.exp(forward[at - 1][:, :, None] + pairs[None] + (emission[at] + backward[at])[:, None, :] - total[at][:, :, None])
    real = np.bincount(tags[at - 1] * 3 + tags[at], minlength=9).reshape(3, 3)
    return grad, real - joint.sum(axis=0)


def fit(features: np.ndarray, tags: np.ndarray, offsets: np.ndarray) -> Field:
    """Maximise the conditional likelihood by steps on batches; ``features`` has a row of hashed ids a token.

    Steps are those of Adam on gradients a token, so weights and tag pairs move alike.
    """
    field = Field(np.zeros((1 << BITS, 3)), np.zeros((3, 3)))
    field.pairs[OUTSIDE, INSIDE] = -1e9
    lengths = np.diff(offsets)
    whole = np.flatnonzero(lengths)
    rng = np.random.default_rng(0)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.pairs)]
    step = 0
    for epoch in range(EPOCHS if len(whole) else 0):
        for batch in np.array_split(rng.permutation(whole), BATCHES):
            if not len(batch):
                continue
            tokens = concat_ranges(offsets[batch], lengths[batch])
            grads = _gradients(field, features[tokens], tags[tokens], lengths[batch])
            step += 1
            for x, g, (mean, square) in zip((field.weights, field.pairs), grads, moments):
                g = g / len(tokens) - DECAY * np.where(x > -1e8, x, 0) / len(tags)
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                x += RATE * (1 - epoch / EPOCHS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            field.pairs[OUTSIDE, INSIDE] = -1e9
    return field


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Base spans as disjoint intervals."""
    out: list[list[int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _another_form(line: str, spans: list[tuple[int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line with its secrets in other forms, or with a keyword and no secret, and the secrets' places."""
    out, marks, at, size = [], [], 0, 0

    def put(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    for a, b in spans:
        put(line[at:a])
        at = b + 1 if line[b : b + 1] in {'"', "'"} else b
        form, quote = rng.randrange(6), rng.choice(['"', "'", ""])
        alphabet = rng.choice(ALPHABETS)
        secret = "".join(rng.choices(alphabet, k=rng.randint(12, 48)))
        link = rng.choice([" = ", ": ", "=", ":", " "])
        start = size
        if form == 0:  # a keyword in prose
            put(f"{rng.choice(KEYWORDS)} {rng.choice(['of', 'for', 'is', 'and', 'was', 'de', 'la', 'der'])}")
            continue
        if form < 3:
            put(rng.choice(KEYWORDS) + rng.choice(["", "s", "_id"]) + link + quote + secret)
        else:
            put("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 8))) + link if form == 3 else "")
            start = size
            put(quote + secret)
        marks.append((start, size))
        put(quote)
    put(line[at:])
    return "".join(out), marks


def _sequence(line: str, spans: list[tuple[int, int]], of_file: list[int]) -> tuple[list[list[int]], list[int]]:
    """Features and tags of a line's tokens."""
    rows, tags, held = [], [], -1
    found = [(m[0], m.start(), m.end()) for m in _word.finditer(line)]
    own = [token_features(t) for t, _, _ in found]
    none = [_hash("none")] * 2
    for i, (_, a, b) in enumerate(found):
        rows.append(own[i][0] + (own[i - 1][1] if i else none) + (own[i + 1][2] if i + 1 < len(own) else none) + of_file)
        inside = next((k for k, (x, y) in enumerate(spans) if x < b and y > a), -1)
        tags.append(OUTSIDE if inside < 0 else INSIDE if inside == held else BEGIN)
        held = inside
    return rows, tags


def _text_features(text: str) -> list[int]:
    tokens = _word.findall(text)
    return file_features(len(tokens), sum(any("0" <= c <= "9" for c in t) for t in tokens))


def _labelled(text: str) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Sequences to learn from in a text: lines near a match, in several forms where they have one, and every few others."""
    of_file, lines = _text_features(text), text.split("\n")
    spans = [_merged(base_spans(x)) for x in lines]
    for i, line in enumerate(lines):
        near = any(spans[max(0, i - 1) : i + 2])
        if near or i % LINE_STEP == 0:
            yield _sequence(line, spans[i], of_file)
        if spans[i]:
            rng = random.Random(xxhash.xxh3_64_intdigest(line))
            for _ in range(FORMS):
                yield _sequence(*_another_form(line, spans[i], rng), of_file)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each short text in the order of hashes, and whether it may have a base match."""
    for batch in batches:
        short = batch.filter(pc.less_equal(pc.utf8_length(batch.column("text")), TRAIN_CHARS))
        yield record(place=short.column("place"), maybe=pc.match_substring_regex(short.column("text"), MAYBE))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            pieces = [(rows[a : a + PIECE], tags[a : a + PIECE]) for rows, tags in _labelled(text) for a in range(0, len(tags), PIECE)]
            yield record(features=pa.array([[x for row in rows for x in row] for rows, _ in pieces], pa.list_(pa.int32())), tags=pa.array([tags for _, tags in pieces], pa.list_(pa.int8())))


def train(texts: DataFrame, text_col: str = "text") -> Field:
    """Fit on a bounded sample: the distinct texts first by hash, with and without a possible base match.

    Tasks make the labelled sequences; the driver gets their features and tags, of 2 * TRAIN_TEXTS
    texts at most. Null texts are not used; without any text every token is outside.
    """
    rows = texts.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("place")).filter(F.col("text").isNotNull())
    marked = materialise(rows.mapInArrow(_marked, "place long, maybe boolean").distinct(), "secret-sample")
    parts = []
    for maybe in (True, False):
        last = marked.filter(F.col("maybe") == maybe).orderBy("place").limit(TRAIN_TEXTS).agg(F.max("place")).first()[0]
        if last is not None:
            own = marked.filter((F.col("maybe") == maybe) & (F.col("place") <= last)).select("place")
            parts.append(own)
    if not parts:
        return fit(np.zeros((0, FEATURES), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    chosen = materialise(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "secret-chosen")
    sample = rows.join(chosen, "place", "left_semi").filter(F.length("text") <= TRAIN_CHARS).groupBy("place").agg(F.first("text").alias("text"))
    found = sample.orderBy("place").select("text").mapInArrow(_learned, "features array<int>, tags array<byte>").toArrow()
    tags = pc.list_flatten(found["tags"]).to_numpy().astype(np.int64)
    lengths = pc.list_value_length(found["tags"]).to_numpy().astype(np.int64)
    return fit(pc.list_flatten(found["features"]).to_numpy().astype(np.int64).reshape(-1, FEATURES), tags, np.concatenate([[0], np.cumsum(lengths)]))


def _added(text: str, tags: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Character spans of tagged tokens, without quotes and separators around them, that touch no base span."""
    tokens, spans = [(m.start(), m.end()) for m in _word.finditer(text)], []
    at = 0
    while at < len(tokens):
        if tags[at] != BEGIN:
            at += 1
            continue
        to = at + 1
        while to < len(tokens) and tags[to] == INSIDE:
            to += 1
        a, b = tokens[at][0], tokens[to - 1][1]
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in "=+/_-"):
            b -= 1
        if a < b and all(b <= x or a >= y for _, x, y in base):
            spans.append(("crf", a, b))
        at = to
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind, the base
    spans and those that the field adds beside them. Null texts count as empty and have none;
    repeated rows have equal results. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = shared.value.weights, shared.value.pairs
        none = weights[_hash("none")] * 2

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                lines = pc.split_pattern(texts, "\n")
                per_doc = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
                offsets, words = split_words(lines.flatten())
                in_doc = np.concatenate([[0], np.cumsum(per_doc)])
                doc_words = np.diff(offsets[in_doc])
                coded = pc.dictionary_encode(words)
                table = np.fromiter((x for t in coded.dictionary.to_pylist() for x in _remembered(t)), np.int64, len(coded.dictionary) * (FEATURES - 2)).reshape(-1, FEATURES - 2)
                own, behind, before = (sum(weights[table[:, j]] for j in columns) for columns in (range(OWN), (OWN, OWN + 1), (OWN + 2, OWN + 3)))
                codes = coded.indices.to_numpy(zero_copy_only=False)
                emission = own[codes]
                begin = offsets[:-1][np.diff(offsets) > 0]
                cuts = np.append(begin, len(codes)).astype(np.int64)
                head = np.zeros(len(codes) + 1, bool)
                head[begin] = True
                head[-1] = True
                emission[~head[:-1]] += behind[codes[np.flatnonzero(~head[:-1]) - 1]]
                emission[head[:-1]] += none
                emission[~head[1:]] += before[codes[np.flatnonzero(~head[1:]) + 1]]
                emission[head[1:]] += none
                digit = np.concatenate([[0], np.cumsum(pc.match_substring_regex(words, r"[0-9]").to_numpy(zero_copy_only=False))])
                digits = digit[offsets[in_doc[1:]]] - digit[offsets[in_doc[:-1]]]
                of_file = np.array([weights[file_features(int(n), int(d))].sum(axis=0) for n, d in zip(doc_words, digits)]).reshape(-1, 3)
                emission += np.repeat(of_file, doc_words, axis=0)
                tags = viterbi(emission, cuts, pairs)
                marked = np.concatenate([[0], np.cumsum(tags == BEGIN)])
                edge = offsets[in_doc]
                maybe = pc.match_substring_regex(texts, MAYBE).to_numpy(zero_copy_only=False)
                out = []
                for i in range(hi - lo):
                    tagged = marked[edge[i + 1]] > marked[edge[i]]
                    if not (maybe[i] or tagged):
                        out.append((0, 0, 0, EMPTY, ""))
                        continue
                    text = texts[i].as_py()
                    base = base_spans(text) if maybe[i] else []
                    more = _added(text, tags[edge[i] : edge[i + 1]], base) if tagged else []
                    kinds = [k for k, _, _ in base]
                    out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)))
                cols = list(zip(*out)) if out else [()] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


EMPTY = hashlib.sha256(b"").hexdigest()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on a bounded sample of ``docs`` and scan all of them."""
    return scan(docs, train(docs, text_col), id_col, text_col)
