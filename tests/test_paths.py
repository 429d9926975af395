import pytest
from graph_helpers import P, make_edges, make_nodes

from conceptmill.operators import paths as PA
from conceptmill.operators.graph import Graph


def test_teaching_order_is_topological_with_shortcuts(graph, one):
    rows = PA.learning_path(graph, "e", one).orderBy("place").collect()
    assert [r.id for r in rows] == ["a", "b", "c", "d", "e"]
    assert [r.status for r in rows] == ["known", "learning", "learning", "gap", "gap"]
    assert {r.id: r.depth for r in rows} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 0}
    short = PA.learning_path(graph, "e", one, include_known=False).orderBy("place").collect()
    assert [(r.id, r.place) for r in short] == [("b", 0), ("c", 1), ("d", 2), ("e", 3)]
    counters = PA.path_counters(PA.learning_path(graph, "e", one)).first()
    assert (counters.total, counters.gap_count, counters.known_count, counters.gaps) == (5, 2, 1, "d,e")


def test_errors(spark, graph, one):
    with pytest.raises(KeyError):
        PA.learning_path(graph, "nowhere", one)
    loop = Graph(make_nodes(spark, [("a", "a", 1, "m", []), ("b", "b", 1, "m", [])]), make_edges(spark, [("a", "b", P, 1.0), ("b", "a", P, 1.0)]))
    with pytest.raises(ValueError):
        PA.learning_path(loop, "a", one)


def test_recommendation_and_readiness(graph, one):
    # a is mastered; b and c wait for a only; d waits for c, which is below the threshold.
    assert [r.id for r in PA.recommend_next(graph, one).collect()] == ["b", "c", "x", "f"]
    rows = {r.id: (r.gaps, r.reviews, r.verdict) for r in PA.readiness(graph, one, graph.nodes).collect()}
    assert rows["d"] == (0, 1, "needs_review") and rows["e"] == (1, 1, "not_ready") and rows["b"] == (0, 0, "ready") and rows["x"] == (0, 0, "ready")
