"""Closures and teaching orders searched inside the tasks, against brute force."""

import random

import pytest
from graph_helpers import P, make_edges, make_nodes

from conceptmill.operators import closure
from conceptmill.operators import graph as G
from conceptmill.operators import paths as PA

RNG = random.Random(3)
NAMES = [f"n{k}" for k in range(40)]
# One end is no node: it counts for depths and is not taught.
LINKS = sorted({(NAMES[a], NAMES[b]) for b in range(1, 40) for a in RNG.sample(range(b), min(b, RNG.randint(0, 3)))} | {("n0", "ghost"), ("ghost", "n39")})
LEVEL = {n: RNG.randint(1, 5) for n in NAMES}


def reach(links, target):
    found, now, hop = {}, {target}, 0
    while now:
        hop += 1
        now = {a for a, b in links if b in now} - set(found)
        found |= dict.fromkeys(now, hop)
    return found


@pytest.fixture(scope="module")
def dag(spark):
    return G.Graph(make_nodes(spark, [(n, n, LEVEL[n], "m", []) for n in NAMES]), make_edges(spark, [(a, b, P, 1.0) for a, b in LINKS]))


@pytest.mark.parametrize("pairs", [1 << 21, 20])
def test_closure(dag, monkeypatch, pairs):
    """blocks that hold too many pairs are halved, down to one target; there is no loop of joins."""
    monkeypatch.setattr(closure, "HELD_PAIRS", pairs)
    found = G.ancestors(dag.prerequisites)
    assert "Join" in found._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.select("id", "ancestor", "hop").collect()]
    assert sorted(got) == sorted((t, a, h) for t in {b for _, b in LINKS} for a, h in reach(LINKS, t).items())


def test_closure_of_some_targets_in_a_cycle(spark):
    """targets may repeat or have no edge; a node of a cycle is its own ancestor."""
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]
    some = spark.createDataFrame([("a",), ("a",), ("d",), ("nobody",), (None,)], "id string")
    got = [tuple(r) for r in G.ancestors(spark.createDataFrame(loop, "source string, target string"), some).select("id", "ancestor", "hop").collect()]
    assert sorted(got) == sorted((t, a, h) for t in "ad" for a, h in reach(loop, t).items()) and ("a", "a", 3) in got


def test_open_ends_and_large_graphs_take_the_loop(spark, monkeypatch):
    """pairs without an end still count, and so does what is too large to hold."""
    edges = spark.createDataFrame([("a", "b"), (None, "a"), ("b", None)], "source string, target string")
    got = {tuple(r) for r in G.ancestors(edges).select("id", "ancestor", "hop").collect()}
    assert {("b", "a", 1), ("a", None, 1), ("b", None, 2), (None, "b", 1), (None, "a", 2)} <= got
    monkeypatch.setattr(closure, "HELD_EDGES", 1)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert {tuple(r) for r in G.ancestors(edges).select("id", "ancestor", "hop").collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


@pytest.mark.parametrize("known", [True, False])
def test_learning_paths(spark, dag, monkeypatch, known):
    """the order of the older form, whose scopes came as one batch of objects."""
    monkeypatch.setattr(closure, "OUT_ROWS", 50)
    mastery = {f"n{k}": 0.9 if k % 3 else 0.4 for k in range(0, 30, 2)}
    one = spark.createDataFrame([*mastery.items()], "concept_id string, mastery double")
    want = []
    for t in NAMES:
        depth = {t: 0} | {a: h for a, h in reach(LINKS, t).items() if a in LEVEL}
        order = PA._teach([{"id": k, "depth": d, "difficulty": LEVEL[k], "needs": [a for a, b in LINKS if b == k]} for k, d in depth.items()])
        kept = [k for k in order if known or k == t or mastery.get(k, 0.0) < 0.85]
        want += [(t, k, place, depth[k], mastery.get(k, 0.0)) for place, k in enumerate(kept)]
    got = [tuple(r) for r in PA.learning_paths(dag, one, dag.nodes.select("id"), known).select("target", "id", "place", "depth", "mastery").collect()]
    assert sorted(got) == sorted(want)


def test_learning_paths_too_large_to_hold(spark, graph, one, monkeypatch):
    """the older way stays for such graphs and agrees."""
    cols = ["target", "id", "place", "depth", "mastery", "status"]
    goals = graph.nodes.filter("id in ('d', 'x')").select("id")
    held = sorted(map(tuple, PA.learning_paths(graph, one, goals).select(cols).collect()))
    monkeypatch.setattr(closure, "HELD_EDGES", -1)
    assert held == sorted(map(tuple, PA.learning_paths(graph, one, goals).select(cols).collect()))
