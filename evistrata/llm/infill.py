"""Fill-in-middle transformation on ropes.

A text is a rope: a balanced tree whose leaves hold pieces and whose nodes cache how many units
(lines) and code points stand below. Two splits at unit ranks give prefix, middle and suffix, which
are concatenated with sentinels in a new order, without touching the leaves in between. The
inversion splits the result's tree at the sentinels and puts the parts back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import text_or_empty
from evistrata.llm._tasks import tidy
from evistrata.llm._words import SLICE_BYTES, slices

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of the texts that are rearranged, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Code points in a leaf.
LEAF = 2048


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (``text``) or a node (``left`` and ``right``); ``units`` counts the line feeds below."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None
    height: int = 0


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), text)


def node(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, "", left, right, max(left.height, right.height) + 1)


def join(a: Rope, b: Rope) -> Rope:
    """``a`` then ``b``; goes down the higher side's edge, so heights stay logarithmic."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return node(a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at the most, turned where they differ by two."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return node(a.left, node(a.right, b))
        return node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return node(node(a, b.left), b.right)
        return node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of leaves of ``size`` code points."""
    level = [leaf(text[i : i + size]) for i in range(0, len(text), size)] or [EMPTY]
    while len(level) > 1:
        level = [node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first ``at`` code points and the rest."""
    if at <= 0 or at >= tree.chars:
        return (EMPTY, tree) if at <= 0 else (tree, EMPTY)
    if tree.left is None:
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    if at < tree.left.chars:
        a, b = split(tree.left, at)
        return a, join(b, tree.right)
    a, b = split(tree.right, at - tree.left.chars)
    return join(tree.left, a), b


def chars_before(tree: Rope, units: int) -> int:
    """Code points in the first ``units`` lines; all of them where there are no more lines."""
    if units <= 0:
        return 0
    if units > tree.units:
        return tree.chars
    before = 0
    while tree.left is not None:
        if units <= tree.left.units:
            tree = tree.left
        else:
            units, before, tree = units - tree.left.units, before + tree.left.chars, tree.right
    at = -1
    for _ in range(units):
        at = tree.text.index("\n", at + 1)
    return before + at + 1


def pieces(tree: Rope) -> Iterator[str]:
    stack = [tree]
    while stack:
        t = stack.pop()
        if t.left is None:
            yield t.text
        else:
            stack += [t.right, t.left]


def flat(tree: Rope) -> str:
    return "".join(pieces(tree))


def lines_of(tree: Rope, text: str) -> int:
    return tree.units + (0 if not text or text[-1] == "\n" else 1)


def rearranged(text: str, draws: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, size: int = LEAF) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle (none where plain), and the output."""
    tree = rope(text, size)
    n = lines_of(tree, text)
    a, b, chance, order = draws
    if not text or any(s in text for s in SENTINELS) or chance % 100 >= rate:
        return n, PLAIN, None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    first = chars_before(tree, low)
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, chars_before(tree, high) - first)
    form = SPM if order % 100 < suffix_first else PSM
    marked = [(PREFIX, prefix), (SUFFIX, suffix)]
    out = EMPTY
    for mark, part in [*(marked[::-1] if form == SPM else marked), (MIDDLE, middle)]:
        out = join(join(out, leaf(mark)), part)
    return n, form, prefix.chars, middle.chars, flat(out)


def restored(output: str, form: str, size: int = LEAF) -> str:
    """The text of an output: its tree is split at the sentinels and joined in the old order."""
    if form == PLAIN:
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == SPM else (PREFIX, SUFFIX, MIDDLE)
    parts, rest, done, at = {}, rope(output, size), 0, 0
    for i, mark in enumerate(order):
        at = output.index(mark, at)
        before, rest = split(rest, at - done)
        if i:
            parts[order[i - 1]] = before
        rest = split(rest, len(mark))[1]
        done = at = at + len(mark)
    parts[MIDDLE] = rest
    return flat(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def draws_of(seed: int, doc_id: Column) -> list[Column]:
    """Four integers below 2^32 from the digest of seed, colon and id; a null id counts as no digits."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text with two cuts between lines, rearranged: doc_id, n, form, prefix_chars, middle_chars, output.

    Cuts, form and order follow from seed and id alone, so reruns agree. Null text counts as empty;
    empty texts and texts that hold a sentinel stay plain. Repeated rows give repeated results, null
    ids share their draws. Other columns are ignored. No shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(a, b - a)
                cols = [part.column(k).to_pylist() for k in range(1, 6)]
                done = [rearranged(text, tuple(draws), rate, suffix_first) for text, *draws in zip(*cols)]
                n, form, first, middle, output = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=[x.split()[0] for x in FORMED.split(", ")],
                )

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return taken.select("doc_id", "text", *draws_of(seed, F.col("doc_id"))).mapInArrow(tidy(rows), FORMED)


def restore(formed: DataFrame) -> DataFrame:
    """Add ``restored``, the text that each ``output`` of ``form`` was made of; other columns stay."""
    kinds = formed.drop("restored").schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("output"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = [restored(x, f) for x, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist())]
                yield part.append_column("restored", pa.array(texts, pa.string()))

    return formed.drop("restored").mapInArrow(tidy(rows), kinds.add("restored", "string"))


def infill_report(docs: DataFrame, seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Digests of each document's output and of the text rebuilt from it; rows as in ``fill_in_middle``."""
    both = restore(fill_in_middle(docs, seed, rate, suffix_first))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
