"""Distance labels against breadth-first searches from every node."""

import random
from collections import defaultdict

import pytest

from tessera.operators import graph, lineage_labels


def distances(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for start in {x for e in edges for x in e}:
        seen, front, depth = {start}, [start], 0
        while front:
            depth += 1
            front = list({b for a in front for b in after[a]} - seen)
            seen |= set(front)
            out |= {(start, b): depth for b in front}
    return out


def shape(kind):
    rng = random.Random(2)
    if kind == "chain, star, cycle":
        chain = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [(f"s{i}", "hub") for i in range(40)] + [("hub", f"t{i}") for i in range(40)]
        return chain + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "n0"), ("n70", "s0"), ("x", "x"), ("n0", "n1")]
    return [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(70)]


@pytest.mark.parametrize("kind", ["chain, star, cycle", "random"])
def test_pairs(spark, kind):
    edges = shape(kind)
    labels = lineage_labels.build(spark.createDataFrame(edges + [(None, "n1"), ("n1", None)], "upstream string, downstream string"))
    want = {k: d for k, d in distances([e for e in edges if e[0] != e[1]]).items() if k[0] != k[1]}
    assert {(r.start, r.node): r.depth for r in labels.pairs().collect()} == want
    assert {(r.node, r.start): r.depth for r in labels.pairs(downstream=False).collect()} == want
    start = "n3" if kind != "random" else "v1"
    nodes = spark.createDataFrame([("n5", "archived"), ("n6", "active"), ("v2", "deleted")], "node string, status string")
    found = {r.node: r.depth for r in graph.lineage_of(labels, nodes, start).collect()}
    assert found == {b: d for (a, b), d in want.items() if a == start and b not in ("n5", "v2")}
    if kind != "random":  # a chain of 70 and two stars are gone in few rounds, and labels stay short
        assert labels.labels.count() <= 2 * 160 * 12


def test_no_edges(spark):
    labels = lineage_labels.build(spark.createDataFrame([], "upstream string, downstream string"))
    assert labels.pairs().count() == 0 and labels.reachable("a").count() == 0
