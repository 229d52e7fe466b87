import random
from collections import defaultdict

import pytest

from lattica.operators import graph


def make(spark, edges):
    return spark.createDataFrame(edges or [(0, 0)], "src long, dst long").where("src >= 0") if edges else spark.createDataFrame([], "src long, dst long")


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        found[n] = seen
    return found


def random_graph(seed):
    r = random.Random(seed)
    return [(r.randrange(9), r.randrange(9)) for _ in range(r.randint(1, 14))]


@pytest.mark.parametrize("seed", range(3))
def test_recursive_operators_against_brute_force(spark, seed):
    edges = random_graph(seed)
    df, r = make(spark, edges), reach(edges)
    seeds = spark.createDataFrame([(edges[0][0],)], "node long")
    assert {x[0] for x in graph.reachable(df, seeds).collect()} == r[edges[0][0]] | {edges[0][0]}
    cyc = {n: min(m for m in r[n] if n in r[m]) for n in r if n in r[n]}
    comps = graph.scc(df)
    assert dict(map(tuple, comps.collect())) == cyc
    base = spark.createDataFrame([(n, 1 << n) for n in r], "node long, mask long")
    masks = dict(map(tuple, graph.mask_fixpoint(base, df).collect()))
    assert masks == {n: (1 << n) | sum(1 << m for m in r[n] - {n}) for n in r}
    for row in graph.cycle_witness(df, comps).collect():
        assert row.path[0] == row.path[-1] == row.component and all(e in edges for e in zip(row.path, row.path[1:]))


def test_closure_of_a_chain_and_a_circle(spark):
    edges = [(k, k + 1) for k in range(12)] + [(20, 21), (21, 20)]
    r = reach(edges)
    assert set(map(tuple, graph.closure(make(spark, edges)).collect())) == {(a, b) for a in r for b in r[a]}


def test_saturating_counts_paths_and_stops_at_two(spark):
    edges = spark.createDataFrame([("a", "w"), ("a", "w"), ("b", "w"), ("r", "r"), ("c", "a")], "src string, dst string")
    base = spark.createDataFrame([("w", 1, 1), ("r", 1, 1)], "node string, lower int, upper int")
    got = {x.node: (x.lower, x.upper) for x in graph.saturating_fixpoint(base, edges).collect()}
    assert got == {"w": (1, 1), "a": (2, 2), "b": (1, 1), "r": (2, 2), "c": (2, 2)}
    cut = spark.createDataFrame([("a",)], "node string")
    assert {x.node: x.lower for x in graph.saturating_fixpoint(base, edges, cut=cut).collect()}["c"] == 0


def test_alias_chains_in_a_circle_claim_nothing(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]
    assert set(map(tuple, graph.alias_chase(spark.createDataFrame(rows, "alias string, target string")).collect())) == {("a", "c"), ("b", "c")}


def mostly_single(seed):
    """A function on some nodes, with a few more edges."""
    r = random.Random(seed)
    n = r.choice([6, 14, 30])
    more = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([0, 1, n // 5, n]))]
    return sorted({(k, r.randrange(n)) for k in range(n) if r.random() < 0.9} | set(more))


def first_shortest(edges, start, inside):
    out = defaultdict(list)
    for a, b in edges:
        if a in inside and b in inside:
            out[a].append(b)
    paths = [[start]]
    while True:
        paths = [[*p, b] for p in paths for b in out[p[-1]]]
        if ended := [p for p in paths if p[-1] == start]:
            return min(ended)
        paths = list({p[-1]: p for p in sorted(paths, reverse=True)}.values())


@pytest.mark.parametrize("seed", [0, 4])
def test_single_and_several_edges_against_brute_force(spark, seed):
    edges = mostly_single(seed)
    df, r = make(spark, edges), reach(edges)
    cyc = {n: min(m for m in r[n] if n in r[m]) for n in r if n in r[n]}
    comps = graph.scc(df)
    assert sorted(map(tuple, comps.collect())) == sorted(cyc.items())
    inside = {c: {n for n in cyc if cyc[n] == c} for c in cyc.values()}
    assert {x.component: x.path for x in graph.cycle_witness(df, comps).collect()} == {c: first_shortest(edges, c, inside[c]) for c in inside}
    own = [(n, f"v{n % 7}") for n in r if n % 3 == 0] + [(1000, "alone"), (None, "none")]
    want = {(n, v) for n in [*r, 1000, None] for m, v in own if m == n or m in r.get(n, ())}
    assert sorted(map(repr, map(tuple, graph.set_fixpoint(spark.createDataFrame(own, "node long, value string"), df).collect()))) == sorted(map(repr, want))
    base = spark.createDataFrame([(n, 1 << n) for n in r if n % 3 == 0], "node long, mask long")
    masks = graph.mask_fixpoint(base, df).collect()
    assert sorted(map(tuple, masks)) == sorted((n, sum(1 << m for m in r[n] | {n} if m % 3 == 0)) for n in r)


@pytest.fixture
def tables(monkeypatch):
    """The tables that operators have written."""
    made, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: made.append(1) or write(df))
    return made


#: A way of 150 steps into a circle of 200.
LONG = [(k, k - 1) for k in range(200, 350)] + [(k, (k + 1) % 200) for k in range(199)] + [(199, 0)]


def test_components_of_long_ways_take_few_rounds(spark, tables):
    assert sorted(map(tuple, graph.scc(make(spark, LONG)).collect())) == [(k, 0) for k in range(200)]
    assert len(tables) <= 20


def test_witness_of_a_long_circle_takes_few_rounds(spark, tables):
    circle = spark.createDataFrame([(k, 0) for k in range(200)], "node long, component long")
    assert [r.path for r in graph.cycle_witness(make(spark, LONG), circle).collect()] == [[*range(200), 0]]
    assert len(tables) <= 20


def test_sets_of_long_ways_take_few_rounds(spark, tables):
    base = spark.createDataFrame([(5, "a"), (300, "b")], "node long, value string")
    got = sorted(map(tuple, graph.set_fixpoint(base, make(spark, LONG)).collect()))
    assert got == sorted([(k, "a") for k in range(350)] + [(k, "b") for k in range(300, 350)])
    assert len(tables) <= 36
