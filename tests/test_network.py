"""Centralities and communities against plain implementations on random graphs."""

from __future__ import annotations

import random

import pytest

from evistrata.operators import network as N


def random_graphs(count, seed, nodes=(2, 24)):
    """Edges (graph, u, v, w): sparse, dense, with planted groups, in several components."""
    rng, rows = random.Random(seed), []
    for g in range(count):
        n, p = rng.randint(*nodes), rng.choice([0.08, 0.15, 0.3, 0.6])
        group = [rng.randrange(1 + g % 4) for _ in range(n)]
        own = [(g, f"n{i:02}", f"n{j:02}", rng.choice([1.0, 1.0, 0.5, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < (p if group[i] == group[j] else p / 4)]
        rows += own or [(g, "n00", "n01", 1.0)]
    return rows


def neighbours(edges):
    near = {}
    for u, v, *_ in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def plain_centralities(edges, sources=None):
    """All pairs: distances and path counts from each node, then every node between every two."""
    near = neighbours(edges)
    dist, paths = {}, {}
    for s in near:
        d, c, queue = {s: 0}, {s: 1}, [s]
        for x in queue:
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    queue.append(y)
                if d[y] == d[x] + 1:
                    c[y] = c.get(y, 0) + c[x]
        dist[s], paths[s] = d, c
    n = len(near)
    out = {}
    used = sorted(sources) if sources is not None else sorted(near)
    for v in near:
        total, reached = sum(dist[v].values()), len(dist[v]) - 1
        b = sum(paths[s][v] * paths[v][t] / paths[s][t] for s in used if s != v and v in dist[s] for t in dist[s] if t not in (s, v) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t])
        out[v] = (b / ((n - 1) * (n - 2)) * n / len(used) if n > 2 else 0.0, reached / total * reached / (n - 1) if total else 0.0)
    return out


def test_centralities(spark):
    rows = random_graphs(25, 1)
    got = {(r.graph, r.node): (r.betweenness, r.closeness) for r in N.centralities(spark.createDataFrame(rows + rows[:9] + [(3, "x", "x", 1.0)], "graph int, u string, v string, w double"), ["graph"]).collect()}
    want = {(g, v): x for g in range(25) for v, x in plain_centralities([r[1:] for r in rows if r[0] == g]).items()}
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


def test_sampled_sources_and_sweeps(spark, monkeypatch):
    rows = [r[1:] for r in random_graphs(1, 5, (60, 60))]
    df = spark.createDataFrame(rows, "u string, v string, w double")
    nodes = spark.createDataFrame([(x,) for x in neighbours(rows)], "node string")
    chosen = {r.node for r in N.sampled(nodes, [], N.F.lit(10), 42).collect()}
    monkeypatch.setattr(N, "SWEEP_ROWS", 1500)
    got = {r.node: (r.betweenness, r.closeness) for r in N.centralities(df, k=10).collect()}
    want = plain_centralities(rows, chosen)
    assert len(chosen) == 10 and set(got) == set(want)
    assert all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)
    full = {r.node: r.betweenness for r in N.centralities(df, k=0).collect()}
    assert all(full[v] == pytest.approx(x[0], abs=1e-12) for v, x in plain_centralities(rows).items())


def plain_modularity(edges, community):
    total = 2 * sum(w for *_, w in edges)
    inside, degree = {}, {}
    for u, v, w in edges:
        for a in (u, v):
            degree[community[a]] = degree.get(community[a], 0) + w
        if community[u] == community[v]:
            inside[community[u]] = inside.get(community[u], 0) + 2 * w
    return sum(inside.get(c, 0) / total - (d / total) ** 2 for c, d in degree.items())


def plain_greedy(edges):
    """Two communities at a time merge, the pair that gains most, while any gains."""
    total = 2 * sum(w for *_, w in edges)
    community = {v: v for e in edges for v in e[:2]}
    while True:
        between, degree = {}, {}
        for u, v, w in edges:
            a, b = sorted((community[u], community[v]))
            between[a, b] = between.get((a, b), 0) + w
            degree[community[u]] = degree.get(community[u], 0) + w
            degree[community[v]] = degree.get(community[v], 0) + w
        gains = [(2 * w / total - 2 * degree[a] * degree[b] / total**2, a, b) for (a, b), w in between.items() if a != b]
        best = max(gains, default=(0,))
        if best[0] <= 1e-12:
            return community
        community = {x: best[1] if c == best[2] else c for x, c in community.items()}


def test_communities(spark):
    rows = random_graphs(24, 2, (6, 30))
    df = spark.createDataFrame(rows, "graph int, u string, v string, w double").cache()
    found = N.communities(df, ["graph"])
    got = {}
    for r in found.collect():
        got.setdefault(r.graph, {})[r.node] = r.community
    q = {r.graph: r.modularity for r in N.modularity(df, found, ["graph"]).collect()}
    below = []
    for g in range(24):
        edges = [r[1:] for r in rows if r[0] == g]
        assert set(got[g]) == set(neighbours(edges))
        assert all(c == min(x for x, d in got[g].items() if d == c) for c in got[g].values())
        assert q[g] == pytest.approx(plain_modularity(edges, got[g]), abs=1e-9)
        if q[g] < plain_modularity(edges, plain_greedy(edges)) - 1e-9:
            below.append(g)
    assert not below


def test_one_graph_and_none(spark):
    two = spark.createDataFrame([(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1.0)], "u long, v long, w double")
    assert {r.node: r.community for r in N.communities(two).collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10)}
    assert N.modularity(two, N.communities(two)).first().modularity > 0.4
    assert N.communities(two.limit(0)).count() == 0 and N.centralities(two.limit(0)).count() == 0
    pair = {r.node: (r.betweenness, r.closeness) for r in N.centralities(spark.createDataFrame([(1, 2, 1.0)], "u long, v long, w double")).collect()}
    assert pair == {1: (0.0, 1.0), 2: (0.0, 1.0)}


def test_communities_send_no_table_of_nodes_to_the_driver(spark, monkeypatch):
    """Tables whose files are small, as those of numbers are, were broadcast: of two keys or more, a graph's and a node's or community's."""
    import re

    from evistrata.operators import graph, network

    plans, write = [], network.checkpointed
    monkeypatch.setattr(network, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    ends = [(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1.0)]
    df = spark.createDataFrame(ends, "src long, dst long, weight double")
    edges = graph.induced(df, df.selectExpr("src AS node").union(df.selectExpr("dst")))
    found = network.communities(edges, trials=2, rounds=2, levels=1)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (edges, found)]
    keys = [k for p in plans for k in re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),(?:true|false)\)", p)]
    assert len(plans) > 10 and not [k for k in keys if k.count("input[") > 1]
    assert "BroadcastExchange" not in plans[-2]
    assert {r.node: r.community for r in found.collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10)}


def test_sets_of_sources_in_blocks(spark, monkeypatch):
    """Closeness searches over bits of sources: 70 nodes take two blocks of a word, and rows are nodes and blocks, not pairs of nodes."""
    from evistrata.operators import network

    monkeypatch.setattr(network, "WORDS", 1)
    monkeypatch.setattr(network, "SET_ROWS", 10)
    pairs = [(0, i) for i in range(1, 60)] + [(59, 60), (61, 62)] + [(61, i) for i in range(63, 70)]
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(70)}
    want = {}
    for i in near:
        far, level, d = {i: 0}, {i}, 0
        while level := {v for u in level for v in near[u]} - set(far):
            d += 1
            far |= dict.fromkeys(level, d)
        want[i] = (len(far), sum(far.values()))
    arcs = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u int, v int")
    got = network.reached_from_all(arcs, arcs.select(arcs.u.alias("node")).distinct(), [])
    assert {r.node: (r.reached, r.total) for r in got.collect()} == want


def test_searches_in_tasks_equal_plain_ones(monkeypatch):
    """Of random components, with leaves, nodes of many neighbours, several parts and blocks of sources."""
    import numpy as np
    import pyarrow as pa

    from evistrata.operators import searches as S

    for name, value in (("COLUMNS", 3), ("ROWS", 4), ("STATE", 400)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(3)
    for trial in range(40):
        n, parts = rng.randint(2, 70), rng.randint(1, 3)
        pairs = sorted({(7 * rng.randrange(i), 7 * i) for i in range(1, n)} | {tuple(7 * x for x in sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([0, 3, n]))})
        want, sources = {}, sorted(rng.sample(range(0, 7 * n, 7), min(n, 9)))
        for i in (near := neighbours(pairs)):
            far, queue = {i: 0}, [i]
            for x in queue:
                for y in near[x] - set(far):
                    far[y] = far[x] + 1
                    queue.append(y)
            want[i] = sum(far.values())
        packed = [np.array(x, np.int64).tobytes() for x in (*zip(*pairs), sources)]
        total, share, like = dict.fromkeys(near, 0), dict.fromkeys(near, 0.0), []
        for part in range(parts):
            row = pa.RecordBatch.from_pylist([{"component": 0, "part": part, "parts": parts, **dict(zip("abs", packed))}])
            for r in (r for out in S._distances(iter([row])) for r in out.to_pylist()):
                if r["like"] is None:
                    total[r["i"]] += r["total"]
                else:
                    like.append(r)
            for r in (r for out in S._through(iter([row])) for r in out.to_pylist()):
                share[r["i"]] += r["share"]
        assert total | {r["i"]: total[r["like"]] + r["total"] for r in like} == want
        scale = n / len(sources) / ((n - 1) * (n - 2)) if n > 2 else 0.0
        assert {i: x * scale for i, x in share.items()} == pytest.approx({i: b for i, (b, _) in plain_centralities(pairs, sources).items()}, abs=1e-12)


@pytest.mark.parametrize("largest", [None, 12])
def test_only_large_components_are_searched_by_joins(spark, monkeypatch, largest):
    """Rows of sources and nodes were joined level by level for every graph, which took minutes from some ten thousand nodes on."""
    from evistrata.operators import searches

    by_joins = []
    if largest:
        monkeypatch.setattr(searches, "LARGEST", largest)
    for name in ("reached_from_all", "shortest_paths"):
        monkeypatch.setattr(N, name, lambda arcs, *rest, of=getattr(N, name): by_joins.append(arcs.count()) or of(arcs, *rest))
    rows = random_graphs(2, 11, (20, 24))
    got = {(r.graph, r.node): (r.betweenness, r.closeness) for r in N.centralities(spark.createDataFrame(rows, "graph int, u string, v string, w double"), ["graph"]).collect()}
    want = {(g, v): x for g in range(2) for v, x in plain_centralities([r[1:] for r in rows if r[0] == g]).items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert bool(by_joins) == bool(largest)


def test_the_query_on_communities_does_its_whole_work(spark, sf_dir, monkeypatch):
    """It asked for one trial, five rounds and one level."""
    import inspect

    from evistrata.plans import q_stats

    asked = []
    monkeypatch.setattr(q_stats.NW, "communities", lambda edges, *bounds, **named: asked.append((bounds, named)) or edges)
    q_stats.g5_communities(spark, sf_dir)
    assert asked == [((), {})]
    monkeypatch.undo()
    given = inspect.signature(N.communities).parameters
    assert given["trials"].default == 4 and given["rounds"].default is None and given["levels"].default is None
