import random

import pytest
from graph_helpers import P, make_edges, make_nodes

from conceptmill.operators import communities as C
from conceptmill.operators import graph as G


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_lookup_and_neighbours(graph):
    assert [r.id for r in G.find(graph, " MAP").collect()] == ["b", "f"]
    assert G.find(graph, "").count() == 7
    assert G.resolve(graph, "routes").first().id == "e"
    assert G.resolve(graph, "nothing here").first() is None
    assert [(r.source, r.target, r.dir) for r in sorted(G.edges_of(graph, "b", P).collect(), key=lambda r: r.dir)] == [("b", "d", 0), ("a", "b", 1)]
    assert ids(G.dependents(graph).filter("id = 'a'"), "dependent") == ["b", "c", "e"]
    assert ids(G.confusable(graph).filter("id = 'f'"), "other") == ["b"]
    assert ids(G.roots(graph)) == ["a"] and ids(G.leaves(graph)) == ["e"] and ids(G.isolated(graph)) == ["x"]
    assert [(r.source, r.target, r.types) for r in G.multi_relation_pairs(graph).collect()] == [("b", "d", "prerequisite_of,related_to")]


def test_build_overwrites_and_checks(spark, graph):
    nodes = make_nodes(spark, [("a", "old", 1, "m", []), ("b", "other", 1, "m", []), ("a", "new", 2, "m", [])])
    edges = make_edges(spark, [("a", "b", P, 0.2), ("a", "b", P, 0.9)])
    g = G.Graph.build(nodes, edges)
    assert [(r.ord, r.id, r.name) for r in g.nodes.orderBy("ord").collect()] == [(0, "a", "new"), (1, "b", "other")]
    assert [r.confidence for r in g.edges.collect()] == [0.9]
    with pytest.raises(ValueError):
        G.Graph.build(nodes, make_edges(spark, [("a", "nowhere", P, 1.0)]))


def test_closure_and_depth(graph):
    got = {(r.id, r.ancestor): r.hop for r in G.ancestors(graph.prerequisites).collect()}
    assert got == {("b", "a"): 1, ("c", "a"): 1, ("d", "b"): 1, ("d", "c"): 1, ("d", "a"): 2, ("e", "d"): 1, ("e", "a"): 1, ("e", "b"): 2, ("e", "c"): 2}
    assert G.ancestors(graph.prerequisites, depth=1).count() == 6
    assert ids(G.ancestors(graph.prerequisites, graph.nodes.filter("id = 'd'"), 1), "ancestor") == ["b", "c"]
    assert G.is_acyclic(graph) and G.cycles(graph) == []


def test_cyclic_core_equals_brute_force(spark):
    rng = random.Random(5)
    for n in (6, 9):
        edges = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(2 * n)}
        follow = {}
        for a, b in edges:
            follow.setdefault(a, set()).add(b)

        def reach(a, follow=follow):
            seen, todo = set(), [*follow.get(a, ())]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += follow.get(x, ())
            return seen

        cyclic = any(a in reach(a) for a in follow)
        core = G.cyclic_core(spark.createDataFrame([*edges], "source string, target string"))
        assert core.isEmpty() != cyclic
        got = {(r.id, r.ancestor) for r in G.ancestors(spark.createDataFrame([*edges], "source string, target string")).collect()}
        assert got == {(b, a) for a in follow for b in reach(a)}


def test_cycles_are_named(spark):
    g = G.Graph(make_nodes(spark, [(c, c, 1, "m", []) for c in "abc"]), make_edges(spark, [("a", "b", P, 1.0), ("b", "c", P, 1.0), ("c", "b", P, 1.0)]))
    assert not G.is_acyclic(g)
    assert G.cycles(g) == [["b", "c"]]


def test_projection_centrality_and_communities(spark, graph, one):
    w = {(r.a, r.b): r.weight for r in G.undirected(graph.edges).collect()}
    assert w["b", "d"] == 1.5
    c = {r.id: r.degree for r in G.degree_centrality(G.undirected(graph.edges), graph.nodes).collect()}
    assert c == {"a": 3, "b": 3, "c": 2, "d": 3, "e": 2, "f": 1, "x": 0}
    clique = lambda s: [(f"{s}{i}", f"{s}{j}", P, 1.0) for i in range(4) for j in range(i)]
    edges = make_edges(spark, clique("p") + clique("q") + [("p0", "q0", P, 0.1)])
    g = G.Graph(make_nodes(spark, [(f"{s}{i}", f"{s}{i}", 1, s, []) for s in "pq" for i in range(4)]), edges)
    found = {r.id: r.community for r in C.detect(g).collect()}
    assert found == {f"{s}{i}": f"{s}0" for s in "pq" for i in range(4)}
    members = C.detect(g)
    assert C.modularity(G.undirected(edges), members).first().modularity > 0.4
    rows = C.summarize(g, members, one).orderBy("ord").collect()
    assert [r.size for r in rows] == [4, 4] and rows[0].id == "community_0" and rows[0].members == ["p0", "p1", "p2", "p3"] and rows[0].hubs[0] == "p0"


def test_display_helpers(graph):
    assert {r.link_id: r.dash for r in G.styled(graph.edges).collect()}["b__d__related_to"] == "4,3"
    assert {(r.type, r.idx, r.n) for r in G.parallel_edges(graph).filter("source = 'b' and target = 'd'").collect()} == {("prerequisite_of", 0, 2), ("related_to", 1, 2)}
    assert {(r.source, r.target) for r in G.facets(graph, ["math"], [P]).collect()} == {("a", "b"), ("a", "c")}
    assert {(r.kind, r.value): r.n for r in G.stats(graph).filter("kind = 'total'").collect()} == {("total", "nodes"): 7, ("total", "edges"): 8, ("total", "roots"): 1, ("total", "isolated"): 1}


def test_cycles_beyond_the_first_nodes(spark):
    """A long chain into a cycle of late nodes, and two more cycles."""
    names = [f"n{i:03}" for i in range(150)]
    chain = [(a, b, P, 1.0) for a, b in zip(names, names[1:], strict=False)] + [("n149", "n120", P, 1.0), ("y", "z", P, 1.0), ("z", "y", P, 1.0), ("s", "s", P, 1.0)]
    g = G.Graph(make_nodes(spark, [(n, n, 1, "d", []) for n in [*names, "s", "y", "z"]]), make_edges(spark, chain))
    assert G.cycles(g) == [names[120:], ["s"], ["y", "z"]] and G.cycles(g, 1) == [names[120:]]
