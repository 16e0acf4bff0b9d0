"""Searches from many nodes of a graph at once, in tasks that hold a component and some of its sources.

Nodes are numbers and edges are (a, b), each once, of at most ``LARGEST`` edges a component. Edges are
packed by component and sent to as many tasks as its searches need; distances come from sets of
sources, a bit a source, path counts from columns of sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.operators.graph import connected_components
from evistrata.operators.written import checkpointed

#: Edges of a component that a task may hold.
LARGEST = 4_000_000
#: Bytes of a task's table of nodes and sources, and sources times edges of a task, about.
STATE, WORK = 64_000_000, 2_000_000_000
#: Neighbours that are met column by column, and nodes that are met at once.
COLUMNS, ROWS = 64, 2048
PACKED = "component long, first long, a binary, b binary, s binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, a, b) in order as a row a component and batch; a row without ``b`` is a source."""
    for batch in batches:
        component, a = (batch.column(c).to_numpy() for c in ("component", "a"))
        edge = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        b = batch.column("b").fill_null(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(component)) + 1), len(component)]
        spans = [slice(i, j) for i, j in zip(cuts, cuts[1:]) if j > i]
        yield pa.RecordBatch.from_pydict({
            "component": pa.array([int(component[x.start]) for x in spans], pa.int64()), "first": pa.array([int(a[x.start]) for x in spans], pa.int64()),
            "a": pa.array([a[x][edge[x]].tobytes() for x in spans], pa.binary()), "b": pa.array([b[x][edge[x]].tobytes() for x in spans], pa.binary()),
            "s": pa.array([a[x][~edge[x]].tobytes() for x in spans], pa.binary()),
        })


def packed(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed edges (a, b) and sources (i) by component, its size (component, n, m, k), and the component of each node (i, component)."""
    of = checkpointed(connected_components(edges, "a", "b").select(F.col("node").alias("i"), "component"))
    rows = edges.select("a", "b").unionByName(sources.select(F.col("i").alias("a"), F.lit(None).cast("long").alias("b")))
    rows = checkpointed(rows.join(of.select(F.col("i").alias("a"), "component").hint("merge"), "a").select("component", "a", "b"))
    size = of.groupBy("component").agg(F.count("*").alias("n"))
    has = rows.groupBy("component").agg(F.count("b").alias("m"), F.count_if(F.col("b").isNull()).alias("k"))
    size = checkpointed(size.join(has.hint("merge"), "component"))
    some = rows.join(size.filter(F.col("m") <= LARGEST).select("component").hint("merge"), "component", "left_semi")
    pieces = some.repartitionByRange("component", "a").sortWithinPartitions("component", "a", "b").mapInArrow(_pack, PACKED)
    return checkpointed(pieces), size, of


def _dealt(pieces: DataFrame, size: DataFrame, sources: str, per_row: int) -> DataFrame:
    """Each component's pieces, once for each of its parts; ``sources`` of a component are shared by its parts, ``per_row`` of them stand in a number."""
    most = 8 * pieces.sparkSession.sparkContext.defaultParallelism
    wanted = F.ceil(F.col(sources) / per_row * F.col("m") * 64 / F.lit(WORK))
    parts = F.least(F.greatest(wanted, F.lit(1)), F.greatest(F.ceil(F.col(sources) / per_row), F.lit(1)), F.lit(most)).cast("int")
    small = checkpointed(size.filter((F.col("m") <= LARGEST) & (F.col(sources) > 0)).select("component", parts.alias("parts")))
    units = min(small.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0], 16 * most)
    each = pieces.join(small.hint("merge"), "component").repartition(most).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.repartition(max(most, 2 * units), "component", "part").sortWithinPartitions("component", "part", "first")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, parts, a, b, s) of each component's part."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("component", "part", "parts", "a", "b", "s"))))
    for (_, part, parts), own in groupby(rows, key=lambda r: r[:3]):
        yield part, parts, *(np.frombuffer(b"".join(x), np.int64) for x in list(zip(*own))[3:])


class _Near:
    """Neighbours of the nodes 0 to n - 1, which have fewer and fewer of them: the k-th ones in columns, and all further ones of those with many."""

    def __init__(self, u: np.ndarray, v: np.ndarray, degree: np.ndarray):
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        near = source[np.argsort(target, kind="stable")]
        start = np.concatenate([[0], np.cumsum(degree)])
        count = [int(np.searchsorted(-degree, -k, "left")) for k in range(min(COLUMNS, int(degree[0])))]
        self.columns = [near[start[:c] + k] for k, c in enumerate(count)]
        self.further = [near[start[i] + COLUMNS : start[i + 1]] for i in range(int(np.searchsorted(-degree, -COLUMNS, "left")))]

    def some(self, x: np.ndarray, by: np.ufunc, i: int, out: np.ndarray, spare: np.ndarray) -> None:
        """Into ``out`` the rows of the neighbours of the nodes from ``i`` on, joined by ``by``: few nodes at once, as they stay in the cache."""
        for k, column in enumerate(self.columns):
            own = column[i : i + len(out)]
            if not len(own):
                break
            rows = spare[: len(own)] if k else out
            np.take(x, own, axis=0, out=rows, mode="clip")
            if k:
                by(out[: len(own)], rows, out=out[: len(own)])
        for j, others in enumerate(self.further[i : i + len(out)]):
            for at in range(0, len(others), ROWS):
                by(out[j], by.reduce(x[others[at : at + ROWS]], axis=0), out=out[j])


def _by_degree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes by falling degree, the edges by their places, and the degrees."""
    ids = np.unique(np.concatenate([a, b]))
    u, v = np.searchsorted(ids, a), np.searchsorted(ids, b)
    degree = np.bincount(np.concatenate([u, v]), minlength=len(ids))
    order = np.argsort(-degree, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    return ids[order], place[u], place[v], degree[order]


def _weighed(near: _Near, weight: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Of each node the sum of its distances from the sources of a part, each times its weight.

    Sources of a word have one weight, so a level's sum is a count of bits.
    """
    n, total = len(weight), np.zeros(len(weight), np.int64)
    order = np.argsort(weight, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(weight[order])) + 1), n]
    words = [order[k : min(k + 64, j)] for i, j in zip(cuts, cuts[1:]) for k in range(i, j, 64)]
    words = words[len(words) * part // parts : len(words) * (part + 1) // parts]
    wide = int(min(32, max(1, STATE // (8 * n))))
    for at in range(0, len(words), wide):
        block = words[at : at + wide]
        ahead, times = np.zeros((n, len(block)), np.uint64), np.array([weight[w[0]] for w in block])
        for k, word in enumerate(block):
            ahead[word, k] = np.uint64(1) << np.arange(len(word), dtype=np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(times)) + 1), len(times)]
        alike, unseen, level, going = [slice(i, j) for i, j in zip(cuts, cuts[1:])], ~ahead, 0, True
        after, spare = np.empty_like(ahead), np.empty_like(ahead[:ROWS])
        while going:
            level, going = level + 1, False
            for i in range(0, n, ROWS):
                own, rest = after[i : i + ROWS], unseen[i : i + ROWS]
                near.some(ahead, np.bitwise_or, i, own, spare)
                np.bitwise_and(own, rest, out=own)
                found = np.bitwise_count(own)
                if found.any():
                    going = True
                    np.bitwise_xor(rest, own, out=rest)
                    for x in alike:
                        total[i : i + ROWS] += level * int(times[x.start]) * found[:, x].sum(axis=1, dtype=np.int64)
            ahead, after = after, ahead
    return total


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, like, total): a part's share of the node's sum of distances, or how much more it is than that of node ``like``.

    A node of one edge is one further from all others than its neighbour, which counts for it as a source too.
    """
    for part, parts, a, b, _ in _units(batches):
        ids, u, v, degree = _by_degree(a, b)
        leaf = degree == 1
        if len(ids) == 2:
            leaf[0] = False
        inner, n = int((~leaf).sum()), len(ids)  # the nodes of one edge are the last ones
        low, high = np.minimum(u, v), np.maximum(u, v)
        own, ends = leaf[high], np.bincount(low[leaf[high]], minlength=inner)
        total = np.full(inner, n - inner if part == 0 else 0, np.int64)
        if inner > 1:
            kept = np.bincount(np.concatenate([low[~own], high[~own]]), minlength=inner)
            order = np.argsort(-kept, kind="stable")
            place = np.empty(inner, np.int64)
            place[order] = np.arange(inner)
            total[order] += _weighed(_Near(place[low[~own]], place[high[~own]], kept[order]), 1 + ends[order], part, parts)
        like = np.full(inner, -1)
        if part == 0:
            ids, like, total = (np.concatenate(x) for x in ((ids[:inner], ids[high[own]]), (like, ids[low[own]]), (total, np.full(n - inner, n - 2))))
        yield pa.RecordBatch.from_pydict({"i": pa.array(ids[: len(like)]), "like": pa.array(like, mask=like < 0), "total": pa.array(total)})


def distance_sums(pieces: DataFrame, size: DataFrame) -> DataFrame:
    """(i, total): the sum of the distances of each node of the packed components from all others of its component."""
    found = checkpointed(_dealt(pieces, size, "n", 64).mapInArrow(_distances, "i long, like long, total long"))
    own = found.filter("like IS NULL").groupBy("i").agg(F.sum("total").alias("total"))
    more = found.filter("like IS NOT NULL").select(F.col("i").alias("__i"), F.col("like").alias("i"), F.col("total").alias("__more"))
    return own.unionByName(own.join(more.hint("merge"), "i").select(F.col("__i").alias("i"), (F.col("total") + F.col("__more")).alias("total")))


def _shares(near: _Near, sources: np.ndarray, n: int) -> np.ndarray:
    """Of each node its share of the shortest paths from the sources, as columns of a table."""
    each, d, going = np.arange(len(sources)), 0, True
    ahead, level = np.zeros((n, len(sources))), np.full((n, len(sources)), -1, np.int32)
    ahead[sources, each], level[sources, each] = 1.0, 0
    paths, out, spare = ahead.copy(), np.empty_like(ahead), np.empty_like(ahead[:ROWS])
    chunks = [slice(i, i + ROWS) for i in range(0, n, ROWS)]
    while going:
        d, going = d + 1, False
        for x in chunks:
            near.some(ahead, np.add, x.start, out[x], spare)
            out[x][level[x] >= 0] = 0.0
            new = out[x] > 0
            if new.any():
                going = True
                level[x][new] = d
                paths[x] += out[x]
        ahead, out = out, ahead
    out.fill(0.0)
    flow = np.empty_like(spare)
    for here in range(d - 1, 0, -1):
        ahead.fill(0.0)
        for x in chunks:
            np.divide(1 + out[x], paths[x], out=ahead[x], where=level[x] == here)
        for x in chunks:
            at = level[x] == here - 1
            if at.any():
                own = flow[: len(at)]
                near.some(ahead, np.add, x.start, own, spare)
                np.multiply(paths[x], own, out=out[x], where=at)
    out[sources, each] = 0.0
    return out.sum(axis=1)


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, parts, a, b, s in _units(batches):
        ids, u, v, degree = _by_degree(a, b)
        near, share, place = _Near(u, v, degree), np.zeros(len(ids)), np.argsort(ids)
        own = place[np.searchsorted(ids[place], np.sort(s)[part::parts])]
        wide = int(min(32, max(1, STATE // (16 * len(ids)))))
        for at in range(0, len(own), wide):
            share += _shares(near, own[at : at + wide], len(ids))
        some = share > 0
        yield pa.RecordBatch.from_pydict({"i": pa.array(ids[some]), "share": pa.array(share[some])})


def path_shares(pieces: DataFrame, size: DataFrame) -> DataFrame:
    """(i, share): what share of the shortest paths from the packed sources leads on through each node, summed; no row where none does."""
    return _dealt(pieces, size, "k", 1).mapInArrow(_through, "i long, share double").groupBy("i").agg(F.sum("share").alias("share"))
