import math

from pyspark.sql import functions as F

from conceptmill.operators import retrieval as R
from conceptmill.operators import vectors as V

TEXTS = [("1", 0, "graph graph theory 图论基础"), ("2", 1, "linear algebra"), ("3", 2, ""), ("4", 3, "图 theory of graphs")]


def index(spark, dim=128):
    df = spark.createDataFrame(TEXTS, "id string, ord long, text string")
    return V.embed(df, "id", "text", dim).join(df.select("id", "ord"), "id")


def test_expression_equals_driver_rule(spark):
    got = {r.id: r.vector for r in index(spark).collect()}
    for ident, _, text in TEXTS:
        want = V.embed_query(text, 128)
        assert len(got[ident]) == 128
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[ident], want, strict=True))
    assert sum(x * x for x in got["3"]) == 0 and abs(sum(x * x for x in got["1"]) - 1) < 1e-5


def test_tokens(spark):
    df = spark.createDataFrame([(" Deep-Learning 图论基础 图 v2",)], "t string")
    assert df.select(V.tokens(F.col("t")).alias("x")).first().x == ["deep", "learning", "图论", "论基", "基础", "图", "v2"]


def test_topk_pool_feedback(spark):
    ix = index(spark)
    q = V.query_column(V.embed_query("graph theory", 128))
    hits = V.topk(ix, q, 3).collect()
    assert hits[0].id == "1" and all(h.sim > 0 for h in hits)
    two = V.max_pool(ix, [q, V.query_column(V.embed_query("linear algebra", 128))], 4).collect()
    assert {h.id for h in two} >= {"1", "2"} and math.isclose(max(h.sim for h in two), 1.0, abs_tol=1e-5)
    fed = V.feedback(ix, [q], 4).collect()
    assert fed[0].id == "1" and math.isclose(fed[0].sim, hits[0].sim, abs_tol=1e-9)
    pairs = V.topk_join(ix, spark.createDataFrame([(7, V.embed_query("algebra", 128))], "qid int, qvec array<double>"), 1)
    assert [(r.qid, r.id) for r in pairs.collect()] == [(7, "2")]


def test_signature_changes_with_content(graph, one):
    base = V.signature(graph.nodes, graph.edges, one, "t").first().signature
    assert base == V.signature(graph.nodes, graph.edges, one, "t").first().signature
    assert base != V.signature(graph.nodes, graph.edges, one.filter("mastery > .5"), "t").first().signature
    assert base != V.signature(graph.nodes, graph.edges, one, "u").first().signature


def test_local_search_fills_weak_first(spark, graph, one):
    hits = spark.createDataFrame([("gone", 1, 0.9), ("d", 2, 0.8), ("b", 3, 0.7)], "id string, rank int, sim double")
    rows = R.local_search(graph, hits, one, top_k=1).orderBy("place").collect()
    assert [(r.id, r.role) for r in rows] == [("d", "seed"), ("c", "prerequisite"), ("b", "prerequisite"), ("e", "neighbor")]
    assert len(R.local_search(graph, hits, one, top_k=1, max_context=2).collect()) == 2
    text = R.rendered(R.local_search(graph, hits, one)).first().context_text
    assert text.startswith("[seed]\n- Graphs (untouched, mastery 0.00): about Graphs")


def test_search_over_an_index(graph, one):
    text = V.node_text(graph.nodes)
    ix = V.embed(text, "id", "text").join(text.select("id", "ord"), "id")
    rows = R.search(graph, ix, "graphs", one).orderBy("place").collect()
    assert rows[0].id == "d" and rows[0].role == "seed"


def test_compare(spark, graph, one):
    golden = spark.createDataFrame([(1, "d"), (2, "x")], "qid int, id string")
    contexts = spark.createDataFrame([("n", 1, "d"), ("n", 2, "a"), ("g", 1, "d"), ("g", 1, "b"), ("g", 1, "a"), ("g", 2, "x")], "mode string, qid int, id string")
    got = {r["mode"]: (r.golden_hit, r.coverage, r.mastered_ratio, r.mean_size) for r in R.compare(contexts, golden, graph.prerequisites, one).collect()}
    assert got == {"n": (0.5, 0.5, 0.5, 1.0), "g": (1.0, 0.833, 0.167, 2.0)}


def test_topk_join_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)] for _ in range(120)]
    ix = spark.createDataFrame([(str(i), i, v) for i, v in enumerate(vectors)], "id string, ord long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 120, 2)] * 2, "qid long, qvec array<double>")
    want = {}
    for q in range(0, 120, 2):
        sims = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in enumerate(vectors))
        want[q] = [(str(i), r + 1) for r, (s, i) in enumerate(sims[:5]) if s < 0]
    for block, cells, blocks in ((4096, 1 << 22, 16), (7, 50, 2)):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        monkeypatch.setattr(V, "HELD_CELLS", cells)
        monkeypatch.setattr(V, "PLAN_BLOCKS", blocks)
        got = {}
        for r in V.topk_join(ix, asked, 5).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r["rank"]))
        assert got == {q: x for q, x in want.items() if x}
    assert V.topk_join(ix, asked.limit(0), 5).count() == 0 and V.topk_join(ix.limit(0), asked, 5).count() == 0


def test_rows_are_read_where_they_lie():
    """rows of equal length never become Python objects; others still become a matrix or raise."""
    import pytest
    import numpy as np
    import pyarrow as pa

    whole = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float64()))
    for part in (whole, whole.slice(1, 2), whole.slice(2, 1), whole.slice(0, 0)):
        assert np.array_equal(V._matrix(part), np.array(part.to_pylist(), float).reshape(len(part), -1) if len(part) else np.zeros(0))
    assert np.isnan(V._matrix(pa.array([[1.0, None]], pa.list_(pa.float64())))[0, 1])
    with pytest.raises(ValueError):
        V._matrix(pa.array([[1.0, 2.0], [3.0]], pa.list_(pa.float64())))
