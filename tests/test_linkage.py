"""Average linkage against one merge after another."""

from __future__ import annotations

import random

import pytest

from evistrata.operators import linkage as L


def plain_linkage(distances):
    """The nearest two clusters merge, by the mean over all pairs of members, until no distance is left."""
    members = {x: [x] for pair in distances for x in pair}
    out = []
    while True:
        best = None
        names = sorted(members)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                own = [distances[tuple(sorted((x, y)))] for x in members[a] for y in members[b] if tuple(sorted((x, y))) in distances]
                if own and (best is None or (sum(own) / len(own), a, b) < best):
                    best = (sum(own) / len(own), a, b)
        if best is None:
            return out
        d, a, b = best
        members[a] += members.pop(b)
        out.append((a, b, d, len(members[a])))


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_tree(spark, share):
    rng, rows, want = random.Random(1), [], {}
    for g, n in enumerate((1, 2, 3, 17, 40)):
        points = [(rng.random(), rng.random()) for _ in range(n)]
        own = {(f"i{x:02}", f"i{y:02}"): ((points[x][0] - points[y][0]) ** 2 + (points[x][1] - points[y][1]) ** 2) ** 0.5 for x in range(n) for y in range(x + 1, n) if rng.random() < share or n < 4}
        want[g] = plain_linkage(own)
        rows += [(g, *((a, b) if rng.random() < 0.5 else (b, a)), d) for (a, b), d in own.items()] + [(g, "i00", "i00", 0.0)]
    got = L.average_linkage(spark.createDataFrame(rows, "g int, a string, b string, distance double"), ["g"]).collect()
    for g, merges in want.items():
        own = sorted((r for r in got if r.g == g), key=lambda r: r.step)
        assert [r.step for r in own] == list(range(1, len(merges) + 1))
        if share == 1.0:
            assert [(r.left, r.right, r.size) for r in own] == [(a, b, n) for a, b, _, n in merges]
            assert all(r.distance == pytest.approx(m[2]) for r, m in zip(own, merges))
        else:
            assert sum(r.size for r in own if r.step == len(merges)) <= 40 and {x for r in own for x in (r.left, r.right)} == {x for m in merges for x in m[:2]}


def test_ties_gaps_and_cuts(spark):
    rows = [("a", "b", 1.0), ("c", "d", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("a", "d", 1.0), ("x", "y", None), ("a", "x", float("nan"))]
    tied = L.average_linkage(spark.createDataFrame(rows, "a string, b string, distance double"))
    assert [(r.left, r.right, r.distance, r["size"]) for r in sorted(tied.collect(), key=lambda r: r.step)] == [("a", "b", 1.0, 2), ("a", "c", 1.0, 3), ("a", "d", 1.0, 4)]
    line = spark.createDataFrame([(i, j, abs(p - q)) for i, p in enumerate((0.0, 1.0, 10.0, 11.5)) for j, q in enumerate((0.0, 1.0, 10.0, 11.5)) if i < j], "a int, b int, distance double")
    tree = L.average_linkage(line)
    assert [(r.left, r.right, r.distance, r["size"]) for r in sorted(tree.collect(), key=lambda r: r.step)] == [(0, 1, 1.0, 2), (2, 3, 1.5, 2), (0, 2, 10.25, 4)]
    assert {r.node: r.component for r in L.cut(tree, 2.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert L.average_linkage(line.limit(0)).count() == 0
