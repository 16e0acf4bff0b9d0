"""Merkle manifest of a dataset: ordered leaf arrays collapse level by level in higher-order SQL functions.

Every row is a leaf. The leaves of a source stand in order and are cut into blocks of ``arity`` to
the power of ``BLOCK_LEVELS``; a block is one array, whose levels ``sequence``, ``transform``,
``slice`` and ``aggregate`` collapse inside the row. The blocks' roots are the next round's leaves,
until a source has one node, and the sources' roots make the last tree alike. On the way down each
block's own levels and its root's path give the paths of its leaves.

A source may hold any share of the rows: places follow from ranges of the order and a count a range,
and no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise

ARITY = 3
#: Levels that one block collapses: 3 ** 5 leaves in an array.
BLOCK_LEVELS = 5
#: The columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """One column's share of a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(columns: tuple[str, ...] = LEAF, **changed: Column) -> Column:
    """The digest of a row over ``columns``; ``changed`` gives other values for some."""
    return digest(*(field(changed.get(c, F.col(c))) for c in columns))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _halves(n: Column, arity: int, most: int) -> Column:
    """Levels from ``n`` nodes up to one node, ``most`` at the most."""
    out = F.lit(0)
    for level in range(most):
        out = F.when(n > arity**level, level + 1).otherwise(out)
    return out


def _up(levels: Column, arity: int) -> Column:
    """The levels with one more on top: each run of ``arity`` nodes becomes its digest, a shorter last one too."""
    top = F.element_at(levels, -1)
    runs = F.sequence(F.lit(0), F.floor((F.size(top) - 1) / arity).cast("int"))
    return F.array_append(levels, F.transform(runs, lambda i: F.sha2(_joined(F.slice(top, i * arity + 1, arity)), 256)))


def _path(levels: Column, place: Column, arity: int) -> Column:
    """What stands before and after a node in its run, level by level; ``place`` counts from 0."""

    def siblings(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(arity)), k)).cast("int")
        own = at % arity
        return F.struct(_joined(F.slice(level, at - own + 1, own)).alias("before"), _joined(F.slice(level, at + 2, arity - 1 - own)).alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), siblings)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to by ``path``."""
    return F.aggregate(path, node, lambda acc, x: digest(x["before"], acc, x["after"]))


def siblings_of(path: Column) -> Column:
    """All siblings of a path as one string, level by level and left to right."""
    return _joined(F.transform(path, lambda x: F.concat(x["before"], x["after"])))


def _placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add ``place`` (from 0 in its group, by ``order``) and ``n`` (rows of the group).

    Rows are written in order with their range and place in it; what the ranges before hold is one
    row a range and group.
    """
    at = F.monotonically_increasing_id()
    t = materialise(rows.orderBy(F.col(group), *order).withColumn("at", at), name)
    part = F.shiftright("at", 33)
    per = t.groupBy(F.col(group).alias("g"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before, whole = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    per = per.select("g", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(whole).alias("n"))
    joined = t.join(per, F.col(group).eqNullSafe(F.col("g")) & (part == F.col("part")))
    return joined.withColumn("place", F.col("at") - F.col("first") + F.col("earlier")).drop("g", "part", "first", "earlier", "at")


def _collapsed(nodes: DataFrame, group: str, kept: list[str], arity: int, block_levels: int, name: str) -> list[DataFrame]:
    """Rounds of blocks from (group, place, n, node, kept) up to one block a group, leaves first.

    Each row is a block: its group, number, the group's number of nodes, its items in order and its
    levels, of which the last is its root alone.
    """
    width = arity**block_levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    while True:
        item = F.struct("place", "node", *kept)
        blocks = nodes.groupBy(group, F.floor(F.col("place") / width).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
        steps = F.when(F.col("n") > width, block_levels).otherwise(_halves(F.col("n"), arity, block_levels))
        counter = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        start = F.array(F.transform("items", lambda x: x["node"]))
        blocks = blocks.withColumn("levels", F.aggregate(counter, start, lambda acc, _: _up(acc, arity)))
        rounds.append(materialise(blocks, f"{name}-blocks"))
        most = -(-most // width)
        if most <= 1:
            return rounds
        top = F.element_at(F.element_at("levels", -1), 1)
        nodes = rounds[-1].select(group, F.col("block").alias("place"), F.ceil(F.col("n") / width).alias("n"), top.alias("node"))
        kept = []


def _paths(rounds: list[DataFrame], group: str, above: DataFrame, kept: list[str], arity: int) -> DataFrame:
    """(group, node, kept, path, and what ``above`` carries) of the leaves.

    ``above`` has a row a group: its name as ``a_group``, its own ``a_path`` and other columns.
    """
    rest = [c for c in above.columns if c not in ("a_group", "a_path")]
    for k, blocks in enumerate(reversed(rounds)):
        last = k == len(rounds) - 1
        names = ["node", *kept] if last else []
        match = F.col(group).eqNullSafe(F.col("a_group"))
        if k:
            match &= F.col("block") == F.col("a_place")
        placed = F.transform("items", lambda x, i: F.struct(x["place"].alias("place"), _path(F.col("levels"), i, arity).alias("path"), *(x[c].alias(c) for c in names)))
        own = blocks.join(above, match).select(group, "a_path", *rest, F.explode(placed).alias("x"))
        path = F.concat("x.path", "a_path")
        if last:
            return own.select(group, *(F.col(f"x.{c}").alias(c) for c in names), path.alias("path"), *rest)
        above = own.select(F.col(group).alias("a_group"), F.col("x.place").alias("a_place"), path.alias("a_path"), *rest)
    raise AssertionError("no round")


def manifest(leaves: DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id",), kept: tuple[str, ...] = (), arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs of rows that carry their digest in ``leaf``: source, order columns, kept, leaf, subroot, root, path.

    ``path`` has what stands before and after the node at each level up to ``root``, so
    ``fold(leaf, path)`` is the root. The leaves of a source ascend by ``order`` (nulls first), then
    by ``leaf``; repeated rows are leaves of their own. A null source is a source, the first one.
    An empty table has no root and gives no row.
    """
    own = list(dict.fromkeys([*order, *kept]))
    slim = materialise(leaves.select(F.col(source).alias("source"), F.struct(*own).alias("own"), F.col("leaf").alias("node")), "leaves")
    # Equal leaves under one place of the order are interchangeable, and their number tells them apart for the ranges.
    number = F.monotonically_increasing_id()
    placed = _placed(slim.withColumn("number", number), "source", [*(F.col("own")[c] for c in order), F.col("node"), F.col("number")], "leaves-in-order").drop("number")
    rounds = _collapsed(placed, "source", ["own"], arity, block_levels, "leaf")
    subroots = rounds[-1].select(F.lit(0).alias("all"), "source", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    upper = _collapsed(_placed(subroots, "all", [F.col("source")], "subroots"), "all", ["source"], arity, block_levels, "subroot")
    root = upper[-1].select(F.col("all").alias("a_group"), F.array().cast(PATH).alias("a_path"), F.element_at(F.element_at("levels", -1), 1).alias("root"))
    by_source = _paths(upper, "all", root, ["source"], arity)
    above = materialise(by_source.select(F.col("source").alias("a_group"), F.col("path").alias("a_path"), F.col("node").alias("subroot"), "root"), "subroot-paths")
    return _paths(rounds, "source", above, ["own"], arity).select("source", "own.*", F.col("node").alias("leaf"), "subroot", "root", "path")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the id's checksum; other texts, null texts and texts of null ids stay."""
    chosen = F.crc32(doc_id.cast("string")) % 2 == 0
    return F.when(chosen, F.translate(text, "\n", "")).otherwise(text)


def verified_manifest(docs: DataFrame, arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Each document's proof, checked against a copy in which some texts were tampered with.

    One row a document: doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root
    (of the copy's leaf and the stored path), verified. Nulls in any column have their own mark in
    the leaf, an empty text is not a null one; repeated rows are leaves side by side. Columns
    beyond the five of a leaf are ignored.
    """
    rows = docs.select(*LEAF).withColumn("leaf", leaf_of())
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    seen = F.when(changed, leaf_of(text=tampered_text(F.col("doc_id"), F.col("text")))).otherwise(F.col("leaf"))
    proofs = manifest(rows.withColumn("seen", seen), kept=("seen",), arity=arity, block_levels=block_levels)
    folded = proofs.withColumn("folded_root", F.when(F.col("seen") == F.col("leaf"), fold(F.col("leaf"), F.col("path"))).otherwise(fold(F.col("seen"), F.col("path"))))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
