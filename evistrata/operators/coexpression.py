"""Gene by gene correlation in tiles: pairwise complete, its null, and edges that are stable under resampling.

A gene's values are packed into one row. Genes fall into blocks, and a task holds a tile, the genes
of two blocks, where sums over the samples that both genes of a pair have are matrix products. A
resample is a weight for each sample, the same in every tile as it follows from the seed alone.

Rows are (keys, gene, sample, value); a value that is null or NaN is a gap, and of a gene's rows for
one sample the smallest value counts. Groups are told apart by keys that are not null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.operators.graph import without_shared_predictors
from evistrata.operators.ordered import exact_percentiles, running
from evistrata.operators.written import checkpointed

#: Genes of a block, about; a tile has two blocks.
TILE_GENES = 128
#: Fewer genes have no null.
LEAST_GENES = 5

Sums = Callable[[np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def packed(df: DataFrame, keys: list[str], gene: str = "gene", sample: str = "sample", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Genes as rows (keys, gene, ``__at``, ``__value``) with sample places from 1, and (keys, ``__n``), the samples of each group."""
    own = df.select(*keys, F.col(gene), F.col(sample).alias("__sample"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__value"))
    places = checkpointed(running(own.select(*keys, "__sample").distinct(), [F.asc("__sample")], {"__at": ("sum", F.lit(1))}, keys))
    per = own.filter("__value IS NOT NULL").join(places, [*keys, "__sample"]).groupBy(*keys, gene)
    genes = per.agg(F.collect_list(F.struct(F.col("__at").cast("int").alias("at"), F.col("__value").alias("v"))).alias("__x"))
    count = places.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else places.agg(F.count("*").alias("__n"))
    return checkpointed(genes.select(*keys, gene, F.col("__x.at").alias("__at"), F.col("__x.v").alias("__value"))), count


def _in_tiles(genes: DataFrame, keys: list[str], gene: str, tile_genes: int) -> DataFrame:
    """Each gene in the tiles of its block with every block, as (``__i`` <= ``__j``)."""
    most = (genes.groupBy(*keys).count() if keys else genes.agg(F.count("*").alias("count"))).agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // tile_genes))
    own = F.pmod(F.xxhash64(gene), F.lit(blocks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: F.struct(F.least(own, c).alias("__i"), F.greatest(own, c).alias("__j")))
    return genes.withColumn("__block", own).withColumn("__tile", F.explode(tiles)).select("*", "__tile.*").drop("__tile")


def _dense(table: pa.Table, n: int, permute: Callable[[object, np.ndarray], np.ndarray] | None, gene: str) -> tuple[np.ndarray, np.ndarray]:
    """Samples by genes around each gene's mean, 0 in gaps, and where there is a value."""
    x, have = np.zeros((n, table.num_rows)), np.zeros((n, table.num_rows))
    names = table.column(gene).to_pylist()
    for k, (at, value) in enumerate(zip(table.column("__at"), table.column("__value"))):
        at, value = at.values.to_numpy(), value.values.to_numpy()
        down = np.argsort(-value, kind="stable")
        column = np.full(n, np.nan)
        column[at[down] - 1] = value[down]
        there = np.flatnonzero(~np.isnan(column))
        values = column[there] - column[there].mean()
        x[there, k] = values if permute is None else permute(names[k], values)
        have[there, k] = 1.0
    return x, have


def correlations(x: np.ndarray, hx: np.ndarray, y: np.ndarray, hy: np.ndarray, least: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's r of each column of ``x`` with each of ``y`` over the samples that both have, and their number; NaN below ``least`` or without spread."""
    xw, hw = (x, hx) if weight is None else (x * weight[:, None], hx * weight[:, None])
    n, sx, sy = hw.T @ hy, xw.T @ hy, hw.T @ y
    sxx, syy = (xw * x).T @ hy, hw.T @ (y * y)
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = np.clip((xw.T @ y - sx * sy / n) / np.sqrt(vx * vy), -1.0, 1.0)
    spread = (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
    return np.where((n >= least) & spread, r, np.nan), n


def _pairs(table: pa.Table, gene: str, n: int | None = None, permute: Callable | None = None) -> tuple[list, list, np.ndarray, tuple]:
    """Names of both blocks, which pairs of them count, and their matrices."""
    block, i, j = table.column("__block").to_numpy(), table.column("__i")[0].as_py(), table.column("__j")[0].as_py()
    left = table.filter(pa.array(block == i))
    right = left if i == j else table.filter(pa.array(block == j))
    if n is None:
        n = max((int(np.max(a.values.to_numpy())) for a in table.column("__at")), default=0)
    x = _dense(left, n, permute, gene)
    y = x if i == j else _dense(right, n, permute, gene)
    us, vs = left.column(gene).to_pylist(), right.column(gene).to_pylist()
    counts = np.triu(np.ones((len(us), len(vs)), bool), 1) if i == j else np.ones((len(us), len(vs)), bool)
    return us, vs, counts, (*x, *y)


def _rows(table: pa.Table, keys: list[str], us: list, vs: list, at: tuple[np.ndarray, np.ndarray], kinds: pa.Schema, rest: dict[str, np.ndarray]) -> pa.Table:
    """Result rows of the pairs ``at``, the smaller name first."""
    ends = [(min(us[a], vs[b]), max(us[a], vs[b])) for a, b in zip(*at)]
    cols = {k: [table.column(k)[0].as_py()] * len(ends) for k in keys} | {"u": [e[0] for e in ends], "v": [e[1] for e in ends]} | rest
    return pa.table({f.name: pa.array(cols[f.name], f.type) for f in kinds}, schema=kinds)


def _tiled(tiles: DataFrame, keys: list[str], gene: str, rest: str, of_tile: Callable[[pa.Table, pa.Schema], pa.Table]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kinds = dict(tiles.dtypes)
    schema: StructType = _parse_datatype_string(", ".join([*(f"{k} {kinds[k]}" for k in keys), f"u {kinds[gene]}", f"v {kinds[gene]}", rest]))
    arrow = to_arrow_schema(schema)
    return tiles.groupBy(*keys, "__i", "__j").applyInArrow(lambda table: of_tile(table, arrow), schema)


def pair_correlations(df: DataFrame, keys: list[str], least_pairs: int = 20, at_least: float = 0.0, gene: str = "gene", tile_genes: int = TILE_GENES) -> DataFrame:
    """(keys, u, v, r, n) of every pair u < v with ``least_pairs`` samples in common and abs r of ``at_least``."""

    def of_tile(table: pa.Table, kinds: pa.Schema) -> pa.Table:
        us, vs, counts, xy = _pairs(table, gene)
        r, n = correlations(*xy, least_pairs)
        with np.errstate(invalid="ignore"):
            at = np.nonzero(counts & (np.abs(r) >= at_least))
        return _rows(table, keys, us, vs, at, kinds, {"r": r[at], "n": n[at].astype(np.int64)})

    genes, _ = packed(df, keys, gene)
    return _tiled(_in_tiles(genes, keys, gene, tile_genes), keys, gene, "r double, n long", of_tile)


def null_threshold(genes: DataFrame, keys: list[str], least_pairs: int = 20, quantile: float = 0.995, perms: int = 2, seed: int = 123, gene: str = "gene", tile_genes: int = TILE_GENES) -> DataFrame:
    """(keys, threshold): the quantile of abs r over all pairs when each gene's values are shuffled among its samples.

    A gene's shuffles follow from the seed, their number and its name, so that they are the same in
    every tile. The quantile is exact, over the values of all tiles. Groups of fewer than five genes
    have no row.
    """

    def of_tile(table: pa.Table, kinds: pa.Schema) -> pa.Table:
        found = []
        for t in range(perms):
            shuffle = lambda name, x, t=t: np.random.default_rng([seed, t, zlib.crc32(str(name).encode())]).permutation(x)
            us, vs, counts, xy = _pairs(table, gene, permute=shuffle)
            r = np.abs(correlations(*xy, least_pairs)[0])
            found.append(r[counts & np.isfinite(r)])
        r = np.concatenate(found)
        names = us if us else vs
        cols = {k: [table.column(k)[0].as_py()] * len(r) for k in keys} | {"u": [names[0]] * len(r), "v": [names[0]] * len(r), "r": r}
        return pa.table({f.name: pa.array(cols[f.name], f.type) for f in kinds}, schema=kinds)

    enough = genes.groupBy(*keys).agg(F.count("*").alias("__genes")).filter(F.col("__genes") >= LEAST_GENES) if keys else genes.agg(F.count("*").alias("__genes")).filter(F.col("__genes") >= LEAST_GENES)
    null = _tiled(_in_tiles(genes, keys, gene, tile_genes), keys, gene, "r double", of_tile).drop("u", "v")
    found = exact_percentiles(checkpointed(null), "r", [quantile], keys).select(*keys, F.col("percentiles")[0].alias("threshold"))
    return found.join(enough.drop("__genes"), keys, "left_semi") if keys else found.join(enough, F.lit(True), "left_semi")


def resample_weights(n: int, reps: int, seed: int) -> Iterator[np.ndarray]:
    """How often each of ``n`` samples is drawn, for each resample with replacement, one after another from one seed."""
    rng = np.random.default_rng(seed)
    for _ in range(reps):
        yield np.bincount(rng.integers(0, n, size=n), minlength=n).astype(float)


STABLE = "w double, n long, selected long, frequency double, sign_consistency double, median_r double, median_abs_r double, median_n long, threshold double"


def coexpression(
    df: DataFrame, keys: list[str], least_pairs: int = 20, quantile: float = 0.995, perms: int = 2, reps: int = 50, stable: float = 0.6, sign: float = 0.9, seed: int = 123,
    predictors: DataFrame | None = None, most_overlap: float = 0.25, gene: str = "gene", tile_genes: int = TILE_GENES,
) -> DataFrame:
    """Stable gene pairs of each group, one row an edge u < v.

    An edge is selected in a resample of the samples when abs r reaches the null's quantile; it stays
    when a share ``stable`` of the resamples select it and a share ``sign`` of these agree in sign.
    ``w`` and ``n`` are r and samples over the whole table, the medians those over the selecting
    resamples. ``predictors`` (gene, snp) rule out edges whose genes share a part ``most_overlap``.
    """
    least = int(np.ceil(stable * reps))

    def of_tile(table: pa.Table, kinds: pa.Schema) -> pa.Table:
        n, limit = table.column("__n")[0].as_py(), table.column("threshold")[0].as_py()
        us, vs, counts, xy = _pairs(table, gene, n)
        drawn, shared = np.full((reps, *counts.shape), np.nan), np.zeros((reps, *counts.shape))
        for b, weight in enumerate(resample_weights(n, reps, seed)):
            r, common = correlations(*xy, least_pairs, weight)
            with np.errstate(invalid="ignore"):
                drawn[b] = np.where(counts & (np.abs(r) >= limit), r, np.nan)
            shared[b] = common
        hit = np.isfinite(drawn)
        times, plus = hit.sum(0), (drawn > 0).sum(0)
        agree = np.maximum(plus, times - plus) / np.maximum(times, 1)
        at = np.nonzero((times >= max(1, least)) & (agree >= sign))
        r, common = correlations(*xy, least_pairs)
        chosen, together = drawn[:, at[0], at[1]], np.where(hit, shared, np.nan)[:, at[0], at[1]]
        medians = [np.nanmedian(x, 0) if x.shape[1] else np.zeros(0) for x in (chosen, np.abs(chosen), together)]
        rest = {
            "w": r[at], "n": common[at].astype(np.int64), "selected": times[at], "frequency": times[at] / reps, "sign_consistency": agree[at],
            "median_r": medians[0], "median_abs_r": medians[1], "median_n": medians[2].astype(np.int64), "threshold": np.full(len(at[0]), limit),
        }
        return _rows(table, keys, us, vs, at, kinds, rest)

    genes, count = packed(df, keys, gene)
    limit = null_threshold(genes, keys, least_pairs, quantile, perms, seed, gene, tile_genes)
    group = limit.join(count, keys) if keys else limit.join(count, F.lit(True))
    placed = _in_tiles(genes, keys, gene, tile_genes)
    tiles = placed.join(group, keys) if keys else placed.join(group, F.lit(True))
    edges = checkpointed(_tiled(tiles, keys, gene, STABLE, of_tile))
    return edges if predictors is None else without_shared_predictors(edges, predictors, most_overlap)
