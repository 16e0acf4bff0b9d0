"""Centralities and communities of large graphs, as rounds of joins on edge tables.

Graphs are undirected edges (u, v, w), each once, without loops; ``by`` names columns that tell
many graphs apart, which all run in the same rounds. A round's tables are checkpointed, so its plan
reads files, and a lost executor repeats one round at the most.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators import searches
from evistrata.operators.ordered import numbered, running
from evistrata.operators.ranking import ranked
from evistrata.operators.scoring import shuffle_key
from evistrata.operators.written import checkpointed

#: Rows of (source, node) that one sweep of the search holds, about.
SWEEP_ROWS = 200_000_000
#: Sources of a word, words of a row, and rows of words that a level of the search over sets holds, about.
WORD, WORDS, SET_ROWS = 64, 32, 2_000_000
#: Moves and merges gain more than this.
LEAST_GAIN = 1e-12


def _arcs(edges: DataFrame, by: list[str], *weights: Column) -> DataFrame:
    e = edges.filter("u <> v")
    return e.select(*by, "u", "v", *weights).unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), *weights))


def _union(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def _left_with(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys, of one row with one row where there are none."""
    return a.join(b, keys, how) if keys else a.join(b, F.lit(True), how)


def shortest_paths(arcs: DataFrame, sources: DataFrame, by: list[str]) -> list[DataFrame]:
    """Level by level (by, source, node, paths): who is first reached at that distance, and by how many shortest paths.

    The next level are the neighbours of a level that are in neither it nor the one before, as an
    undirected search never skips one.
    """
    key = [*by, "source", "node"]
    levels = [checkpointed(sources.select(*by, "source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))]
    while True:
        near = levels[-1].withColumnRenamed("node", "u").join(arcs.select(*by, "u", "v"), [*by, "u"])
        ahead = near.groupBy(*by, "source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        for before in levels[-2:]:
            ahead = ahead.join(before.select(*key), key, "left_anti")
        ahead = checkpointed(ahead.select(*key, "paths"))
        if ahead.isEmpty():
            return levels
        levels.append(ahead)


def _dependencies(arcs: DataFrame, levels: list[DataFrame], by: list[str]) -> DataFrame | None:
    """(by, node, share): the shares of the sources' shortest paths that lead on through a node, summed from the last level back."""
    key, found, behind = [*by, "source", "node"], [], None
    for here, nearer in zip(levels[:0:-1], levels[-2::-1]):
        own = here if behind is None else here.join(behind, key, "left")
        share = F.lit(0.0) if behind is None else F.coalesce("share", F.lit(0.0))
        flow = own.select(*by, "source", F.col("node").alias("u"), ((1 + share) / F.col("paths")).alias("flow")).join(arcs.select(*by, "u", "v"), [*by, "u"])
        summed = flow.groupBy(*by, "source", F.col("v").alias("node")).agg(F.sum("flow").alias("flow"))
        behind = checkpointed(nearer.join(summed, key).select(*key, (F.col("paths") * F.col("flow")).alias("share")))
        found.append(behind.filter(F.col("source") != F.col("node")).groupBy(*by, "node").agg(F.sum("share").alias("share")))
    return _union(found).groupBy(*by, "node").agg(F.sum("share").alias("share")) if found else None


def sampled(nodes: DataFrame, by: list[str], k: Column, seed: int) -> DataFrame:
    """The first ``k`` nodes of each graph in an order that seed and name give; ``k`` may use columns of ``nodes``."""
    placed = ranked(nodes, [shuffle_key(seed, F.lit(0), F.col("node")), F.col("node")], by, "__place")
    return placed.filter(F.col("__place") <= k).drop("__place")


def reached_from_all(arcs: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, reached, total): how many nodes reach each node, itself among them, and the sum of their distances.

    Sources are bits: a row is a node and a block of sources, and a level's row is the union of its
    neighbours' sets, so a level costs a bit for what would be a row of (source, node). Of sets that
    meet on the way only unions are shuffled. Blocks of sources run after each other, so that a level
    has ``SET_ROWS`` rows at the most, about.
    """
    words, own = [f"w{k}" for k in range(WORDS)], WORD * WORDS
    placed = checkpointed(running(nodes.select(*by, "node"), [F.col("node")], {"__i": ("sum", F.lit(1).cast("long"))}, by).withColumn("__i", F.col("__i") - 1))
    size = placed.agg(F.count("*"), F.max("__i")).first()
    blocks = -(-((size[1] or 0) + 1) // own)
    step = max(1, SET_ROWS // max(1, size[0]))
    bit = lambda k: F.when(F.floor(F.col("__i") % own / WORD) == k, F.expr(f"shiftleft(1L, CAST(__i % {WORD} AS INT))")).otherwise(F.lit(0).cast("long"))
    key, found = [*by, "__block", "node"], []
    edges = arcs.select(*by, "u", "v")
    some = reduce(lambda a, b: a | b, (F.col(w) != 0 for w in words))
    count = reduce(lambda a, b: a + b, (F.bit_count(w).cast("long") for w in words))
    for first in range(0, blocks, step):
        block = F.floor(F.col("__i") / own).cast("int")
        ahead = checkpointed(placed.filter(block.between(first, first + step - 1)).select(*by, block.alias("__block"), "node", *(bit(k).alias(w) for k, w in enumerate(words))))
        levels = [ahead]
        while not ahead.isEmpty():
            near = ahead.withColumnRenamed("node", "u").join(edges, [*by, "u"]).groupBy(*by, "__block", F.col("v").alias("node")).agg(*(F.bit_or(w).alias(w) for w in words))
            # An undirected search never skips a level: what is new is in neither this one nor the one before.
            for n, before in enumerate(levels[-2:]):
                past = before.select(*key, *(F.col(w).alias(f"__{n}{w}") for w in words))
                near = near.join(past, key, "left").select(*key, *(F.expr(f"{w} & ~coalesce(__{n}{w}, 0L)").alias(w) for w in words))
            ahead = checkpointed(near.filter(some))
            levels.append(ahead)
        found += [x.select(*by, "node", count.alias("reached"), (count * d).alias("total")) for d, x in enumerate(levels)]
    return checkpointed(_union(found).groupBy(*by, "node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total")))


def centralities(edges: DataFrame, by: list[str] = (), k: int | None = None, seed: int = 42) -> DataFrame:
    """(by, node, betweenness, closeness) of every node with an edge.

    Closeness is exact: the share of nodes reached over their mean distance. Betweenness counts the
    shortest paths from ``k`` sources, scaled to all of them; None takes all, 0 the larger of 100
    and the square root of the number of nodes. Duplicate edges count once; a graph of two nodes has
    betweenness 0. Components are searched in tasks that hold one and some of its sources; those of
    more than ``searches.LARGEST`` edges by joins, in sweeps of ``SWEEP_ROWS`` at the most.
    """
    by = list(by)
    arcs = checkpointed(_arcs(edges, by).distinct())
    nodes = arcs.select(*by, F.col("u").alias("node")).distinct()
    size = nodes.groupBy(*by).agg(F.count("*").alias("n")) if by else nodes.agg(F.count("*").alias("n"))
    sized = checkpointed(numbered(_left_with(nodes, size, by, "inner"), [F.col(c) for c in (*by, "node")], "i"))
    if k is None:
        chosen = sized.withColumn("counts", F.lit(True))
    else:
        most = F.least("n", F.greatest(F.lit(100), F.floor(F.sqrt("n")))) if k == 0 else F.least("n", F.lit(k))
        some = sampled(sized, by, most, seed).select(*by, "node", F.lit(True).alias("counts"))
        chosen = sized.join(some, [*by, "node"], "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
    chosen = checkpointed(chosen)
    a, b = (sized.select(*by, F.col("node").alias(e), F.col("i").alias(n)) for e, n in (("u", "a"), ("v", "b")))
    ends = checkpointed(_by_rows(_by_rows(arcs.filter("u < v"), a, [*by, "u"]), b, [*by, "v"]).select("a", "b"))
    pieces, sizes, of = searches.packed(ends, chosen.filter("counts").select("i"))
    reached = _by_rows(of, sizes.select("component", F.col("n").alias("reached"), "m"), ["component"])
    near = [_by_rows(searches.distance_sums(pieces, sizes), reached, ["i"]).select("i", "reached", "total")]
    through = [searches.path_shares(pieces, sizes)]
    if not sizes.filter(F.col("m") > searches.LARGEST).isEmpty():
        large = checkpointed(_by_rows(chosen, reached.filter(F.col("m") > searches.LARGEST).select("i"), ["i"], "left_semi"))
        own = _by_rows(arcs, large.select(*by, F.col("node").alias("u")), [*by, "u"], "left_semi")
        near.append(_by_rows(large.select("i", *by, "node"), reached_from_all(own, large, by), [*by, "node"]).select("i", "reached", "total"))
        counted = large.filter("counts")
        sweeps = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // SWEEP_ROWS))
        for sweep in range(sweeps):
            part = counted.filter(F.pmod(F.xxhash64("node"), F.lit(sweeps)) == sweep)
            shares = _dependencies(own, shortest_paths(own, part.select(*by, F.col("node").alias("source")), by), by)
            through += [] if shares is None else [_by_rows(large.select("i", *by, "node"), shares, [*by, "node"]).select("i", "share")]
    used = chosen.filter("counts").groupBy(*by).agg(F.count("*").alias("used")) if by else chosen.filter("counts").agg(F.count("*").alias("used"))
    rows = _left_with(chosen.join(_union(near), "i"), used, by, "inner")
    rows = rows.join(_union(through).groupBy("i").agg(F.sum("share").alias("share")), "i", "left")
    others = F.col("reached") - 1
    close = F.when(F.col("total") > 0, others / F.col("total") * others / (F.col("n") - 1)).otherwise(0.0)
    between = F.when(F.col("n") > 2, F.coalesce("share", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2)) * F.col("n") / F.col("used")).otherwise(0.0)
    return rows.select(*by, "node", between.alias("betweenness"), close.alias("closeness"))


def modularity(edges: DataFrame, members: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, modularity) of a partition (by, node, community)."""
    by = list(by)
    return _modularity(_arcs(edges, by, "w"), members, by)


def _modularity(arcs: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    u = members.select(*by, F.col("node").alias("u"), F.col("community").alias("cu"))
    v = members.select(*by, F.col("node").alias("v"), F.col("community").alias("cv"))
    per = _by_rows(_by_rows(arcs, u, [*by, "u"]), v, [*by, "v"]).groupBy(*by, "cu").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = per.groupBy(*by).agg(F.sum("degree").alias("all")) if by else per.agg(F.sum("degree").alias("all"))
    q = F.sum(F.col("inside") / F.col("all") - (F.col("degree") / F.col("all")) ** 2).alias("modularity")
    whole = _left_with(per, total, by, "inner")
    return whole.groupBy(*by).agg(q) if by else whole.agg(q)


def _by_rows(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the graph: both are shuffled, however small their files are, and none goes to the driver."""
    return a.join(b.hint("merge"), keys, how)


def _heated(members: DataFrame, by: list[str]) -> DataFrame:
    """Members (by, node, community, k) with ``home``, the summed ``k`` of their community."""
    heat = members.groupBy(*by, "community").agg(F.sum("k").alias("home"))
    return checkpointed(_by_rows(members, heat, [*by, "community"]).select(*by, "node", "community", "k", "home"))


def _each_alone(arcs: DataFrame, by: list[str]) -> DataFrame:
    """Every node with its summed weight ``k``, as its own community."""
    weight = arcs.groupBy(*by, "u").agg(F.sum("w").alias("k"))
    return checkpointed(weight.select(*by, F.col("u").alias("node"), F.col("u").alias("community"), "k", F.col("k").alias("home")))


def _together(arcs: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, w) of the arcs within a community of members (by, node, community)."""
    u = members.select(*by, F.col("node").alias("u"), F.col("community").alias("cu"))
    v = members.select(*by, F.col("node").alias("v"), F.col("community").alias("cv"))
    return _by_rows(_by_rows(arcs, v, [*by, "v"]), u, [*by, "u"]).filter("cu = cv").select(*by, "w")


def _score_parts(inside: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Rows of (by, inside, squares) whose sums give the modularity of members (by, community, k) with the arcs ``inside``."""
    heat = members.groupBy(*by, "community").agg(F.sum("k").alias("heat"))
    return inside.select(*by, F.col("w").alias("inside"), F.lit(0.0).alias("squares")).unionByName(heat.select(*by, F.lit(0.0).alias("inside"), (F.col("heat") ** 2).alias("squares")))


def _moves(arcs: DataFrame, members: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, community, target, gain): each node's best move to a neighbouring community, where it gains.

    Members are (by, node, community, k, home), so a neighbour brings the weight of its community
    along; ``total`` is (by, all), one row a graph.
    """
    of = members.select(*by, F.col("node").alias("v"), F.col("community").alias("c"), F.col("home").alias("heat"))
    near = _by_rows(arcs.filter("u <> v"), of, [*by, "v"]).select(*by, F.col("u").alias("node"), "c", "w", "heat").repartition(*by, "node")
    links = near.groupBy(*by, "node", "c").agg(F.sum("w").alias("to"), F.max("heat").alias("heat"))
    rows = _by_rows(links, members, [*by, "node"])
    stays = F.max(F.when(F.col("c") == F.col("community"), F.col("to"))).over(Window.partitionBy(*by, "node"))  # a row a neighbouring community
    rows = _left_with(rows.withColumn("stays", stays).filter("c <> community"), total, by, "inner")
    gain = 2 * (F.col("to") - F.coalesce("stays", F.lit(0.0))) / F.col("all") - 2 * F.col("k") * (F.col("heat") - F.col("home") + F.col("k")) / F.col("all") ** 2
    better = rows.withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
    # Of targets that gain alike, to the last digits, the first: results agree however sums were ordered.
    return better.groupBy(*by, "node", "community").agg(F.min(F.struct((-F.round("gain", 12)).alias("loss"), F.col("c").alias("target"))).alias("best")).select(*by, "node", "community", F.col("best.target").alias("target"), (-F.col("best.loss")).alias("gain"))


def _apart(moves: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, target, gain) of moves that share no community: each is the best one of both its communities, so that their gains add up."""
    place = F.struct((-F.col("gain")).alias("loss"), "node", "target")
    ends = moves.select(*by, "node", "target", "gain", F.explode(F.array("community", "target")).alias("c"))
    best = ends.groupBy(*by, "c").agg(F.min(place).alias("first")).select(*by, F.col("first.node").alias("node"), F.col("first.target").alias("target"), (-F.col("first.loss")).alias("gain"))
    return best.groupBy(*by, "node").agg(F.count("*").alias("ends"), F.max("target").alias("target"), F.max("gain").alias("gain")).filter("ends = 2").drop("ends")


def _settled(arcs: DataFrame, members: DataFrame | None, total: DataFrame, by: list[str], rounds: int | None, seed: int) -> tuple[DataFrame, bool]:
    """Rounds of moves until none gains: half of all moves at once where that beats the moves that share no community.

    The latter's gains add up, so only the former's modularity has to be computed. Members are
    (by, node, community, k, home); without them each node starts alone.
    """
    score, alone = None, members is None
    members = _each_alone(arcs, by) if alone else members
    for r in count() if rounds is None else range(rounds):
        moves = checkpointed(_moves(arcs, members, total, by))
        if moves.isEmpty():
            break
        if score is None:
            within = arcs.filter("u = v").select(*by, "w") if alone else _together(arcs, members, by)
            sums = _score_parts(within, members, by).groupBy(*by).agg(F.sum("inside").alias("inside"), F.sum("squares").alias("squares"))
            score = checkpointed(_left_with(sums, total, by, "inner").select(*by, (F.col("inside") / F.col("all") - F.col("squares") / F.col("all") ** 2).alias("modularity"), "all"))
        bold = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *by, "node"), F.lit(2)) == 0
        to = moves.select(*by, "node", F.when(bold, F.col("target")).alias("bold"))
        apart = _apart(moves, by).select(*by, "node", F.col("target").alias("careful"), "gain")
        step = checkpointed(
            _by_rows(_by_rows(members.select(*by, "node", "community", "k"), to, [*by, "node"], "left"), apart, [*by, "node"], "left")
            .select(*by, "node", "k", F.coalesce("bold", "community").alias("bold"), F.coalesce("careful", "community").alias("careful"), "gain")
        )
        risky = step.select(*by, "node", F.col("bold").alias("community"), "k")
        parts = _score_parts(_together(arcs, risky, by), risky, by)
        sure = step.filter(F.col("gain").isNotNull()).select(*by, "gain")
        sums = _union([parts, sure, score], missing=True).groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("inside", "squares", "gain", "modularity", "all")))
        q = F.col("inside") / F.col("all") - F.col("squares") / F.col("all") ** 2
        safe = F.col("modularity") + F.col("gain")
        wins = checkpointed(sums.select(*by, (q > safe).alias("wins"), F.greatest(q, safe).alias("modularity"), "all"))
        chosen = _left_with(step, wins.select(*by, "wins"), by, "inner").select(*by, "node", F.when(F.col("wins"), F.col("bold")).otherwise(F.col("careful")).alias("community"), "k")
        members, score = _heated(chosen, by), wins.select(*by, "modularity", "all")
    return members, score is not None


def _contracted(arcs: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """The graph whose nodes are the communities; what lies within one is its loop."""
    u = members.select(*by, F.col("node").alias("u"), F.col("community").alias("cu"))
    v = members.select(*by, F.col("node").alias("v"), F.col("community").alias("cv"))
    return checkpointed(_by_rows(_by_rows(arcs, v, [*by, "v"]), u, [*by, "u"]).groupBy(*by, F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))


def _renamed(members: DataFrame, to: DataFrame, by: list[str]) -> DataFrame:
    """Members of communities that now belong to communities of their own."""
    names = to.select(*by, F.col("node").alias("community"), F.col("community").alias("__to"))
    return checkpointed(_by_rows(members.select(*by, "node", "community", "k"), names, [*by, "community"]).select(*by, "node", F.col("__to").alias("community"), "k"))


def _merged(fine: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, community, k) of rounds in which every two communities merge that are each other's best merge."""
    alone = _each_alone(fine, by)
    members, arcs = alone.select(*by, "node", "community", "k"), fine
    while True:
        moves = checkpointed(_apart(_moves(arcs, alone, total, by), by))
        if moves.isEmpty():
            return members
        to = moves.select(*by, "node", "target")
        step = checkpointed(_by_rows(alone, to, [*by, "node"], "left").select(*by, "node", F.coalesce("target", "community").alias("community")))
        members, arcs = _renamed(members, step, by), _contracted(arcs, step, by)
        alone = _each_alone(arcs, by)


def communities(edges: DataFrame, by: list[str] = (), trials: int = 4, rounds: int | None = None, levels: int | None = None, seed: int = 42) -> DataFrame:
    """(by, node, community) that raise modularity: nodes move, communities become nodes and move, then nodes once more.

    A community is named by its smallest node. Every round takes, of two sets of moves, the one with
    the higher modularity; one of them never lowers it. ``trials`` run beside each other, with other
    moves at once, every second one from communities that merged in pairs, and each graph keeps the
    best. Nodes without an edge have no row; weights are positive. Rounds go on until no move gains
    and no communities merge; ``rounds`` may bound the moves of a level and ``levels`` how often the
    graph contracts, and the partition is whole wherever they end.
    Tables of nodes, communities and arcs meet by shuffles; the driver gets one row a graph and trial.
    """
    whole, by = list(by), [*by, "__trial"]
    tried = edges.select(*whole, "u", "v", "w").withColumn("__trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    fine = checkpointed(_arcs(tried, by, "w").groupBy(*by, "u", "v").agg(F.sum("w").alias("w")))
    total = checkpointed(fine.groupBy(*by).agg(F.sum("w").alias("all")))
    paired = F.col("__trial") % 2 == 0
    members = None
    if trials > 1:
        alone = _each_alone(fine.filter(~paired), by).select(*by, "node", "community", "k")
        members = _heated(alone.unionByName(_merged(fine.filter(paired), total, by)), by)
    for level in count() if levels is None else range(levels):
        members, _ = _settled(fine, members if level == 0 else _heated(members, by), total, by, rounds, seed)
        arcs, step, any_merge = fine, members, False
        while True:
            arcs = _contracted(arcs, step, by)
            step, moved = _settled(arcs, None, total, by, rounds, seed)
            if not moved:
                break
            any_merge = True
            members = _renamed(members, step, by)
        if not any_merge:
            break
    members = _each_alone(fine, by) if members is None else members
    if trials > 1:
        best = F.min(F.struct((-F.round("modularity", 12)).alias("loss"), "__trial")).alias("best")
        scores = _modularity(fine, members, by)
        first = checkpointed((scores.groupBy(*whole).agg(best) if whole else scores.agg(best)).select(*whole, F.col("best.__trial").alias("__trial")))
        members = members.join(first, by, "left_semi")
    names = members.groupBy(*whole, "community").agg(F.min("node").alias("__name"))
    return _by_rows(members, names, [*whole, "community"]).select(*whole, "node", F.col("__name").alias("community"))
