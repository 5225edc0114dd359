import random

from stratalens.operators import graph
from stratalens.operators.components import connected_components
from stratalens.operators.small_graph import shortest_cycle, tarjan


def closure_scc(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach[b] for b in reach[a])) - reach[a] if reach[a] else set()
            if more:
                reach[a] |= more
                changed = True
    return {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in reach}


def test_tarjan_matches_closure():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 12)
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(1, 25))]
        assert tarjan(edges) == closure_scc(edges)


def test_distributed_matches_driver(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)] + [("s", "s"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    df = spark.createDataFrame(edges, "source string, target string")
    key = lambda rows: sorted(tuple(r) for r in rows)
    near = graph.scc(df)
    assert key(near.collect()) == key(graph.distributed_scc(df.distinct()).collect())
    members = graph.cyclic_nodes(df, near)
    few = graph.witnesses(df, members).collect()
    assert key(few) == key(graph.distributed_witnesses(graph._within(df, members)).collect())
    cycles = {r.component: r.cycle for r in few}
    assert cycles["s"] == ["s", "s"] and cycles["a"] == ["a", "b", "a"]
    parts = {r.node: r.component for r in connected_components(df, "source", "target").collect()}
    assert parts["c"] == "a" and parts["s"] == "s"


def test_long_path_components(spark):
    n = 300
    df = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in connected_components(df).collect()} == {0}


def test_no_cycle():
    assert shortest_cycle([("a", "b"), ("b", "c")], "a") is None
