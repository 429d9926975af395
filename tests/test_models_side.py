import json

import pytest

from conceptmill.operators import embedders as M
from conceptmill.operators import extract as E
from conceptmill.operators import retrieval as R
from conceptmill.operators import vectors as V
from conceptmill.plans import answers, index
from conceptmill.sources import connector as K
from conceptmill.sources import files as X


def test_embedders(spark):
    class Embeddings:
        """A client whose vectors are counts of letters."""

        def embeddings(self, texts):
            return [[t.count(c) * 1.0 for c in "abcdefgh"] for t in texts]

    api = M.ClientEmbedder(Embeddings, "m", "http://secret-host/v1/")
    df = spark.createDataFrame([(1, "abba"), (2, None), (3, "h" * 9)], "k long, t string")
    got = {r.k: list(r.vector) for r in api.embed(df, "k", "t").collect()}
    assert got[1][:2] == pytest.approx([0.5**0.5] * 2) and got[2] == [0.0] * 8 and got[3][7] == 1.0
    assert "secret" not in api.identity() and api.identity() == M.ClientEmbedder(Embeddings, "m", "http://secret-host/v1").identity()
    assert isinstance(M.choose(), M.HashEmbedder) and isinstance(M.choose(K.Config(base_url="b", embedding_model="e")), M.ClientEmbedder)
    assert M.HashEmbedder().identity() != M.HashEmbedder(8).identity()


def test_keywords_and_rerank(spark, graph, one):
    assert R.query_keywords(K.Scripted(['{"keywords": [" a ", "", 3, "b", "c", "d", "e", "f"]}']), "q") == ["a", "3", "b", "c", "d", "e"]
    assert R.query_keywords(K.Scripted(["no"]), "q") == [] and R.query_keywords(K.Scripted([K.ClientError("x")]), "q") == []
    assert R.query_list("q", ["q", "", "r"]) == ["q", "r"]
    hits = spark.createDataFrame([("b", 1, 0.9)], "id string, rank int, sim double")
    plain = [r.id for r in R.local_search(graph, hits, one, 1).orderBy("place").collect()]
    turned = [r.id for r in R.local_search(graph, hits, one, 1, rerank=K.Scripted(['["f", "zzz", "d"]']), query="q").orderBy("place").collect()]
    assert plain == ["b", "a", "d", "f"] and turned == ["b", "a", "f", "d"]
    assert [r.id for r in R.local_search(graph, hits, one, 1, rerank=K.Scripted(["?"]), query="q").orderBy("place").collect()] == plain


def test_index_is_loaded_only_while_it_fits(spark, graph, one, tmp_path):
    path = str(tmp_path / "ix")
    made, fresh = index.load_or_build(spark, path, graph, one)
    assert fresh and made.nodes.count() == 7 and made.communities.count() >= 2
    again, fresh = index.load_or_build(spark, path, graph, one)
    assert not fresh and again.signature == made.signature
    assert index.load(spark, path, graph, one.filter("mastery > .5")) is None
    assert index.load(spark, path, graph, one, M.HashEmbedder(64)) is None
    assert index.load(spark, str(tmp_path / "none"), graph, one) is None
    assert index.strangers(made.nodes.filter("id != 'a'"), graph.nodes).collect()[0].side == "graph"


def test_answers_are_judged_and_averaged(graph, one):
    ix = index.build(graph, one)
    replies = ["Graphs it is", '{"faithfulness": 0.5, "relevancy": 2}', "nothing", "unreadable", "x", '{"faithfulness": 1, "relevancy": 0.5}', "y", '{"faithfulness": -1}']
    means, rows = answers.evaluate(graph, ix.nodes, one, [(1, "graphs", ["d"]), (2, "sets", [])], K.Scripted(replies), names=ix.names)
    assert rows[0]["naive_golden_coverage"] == 1.0 and rows[0]["graph_golden_coverage"] == 0.0 and rows[1]["naive_golden_coverage"] == 1.0
    assert means == {"queries": 2, "naive_faithfulness": 0.75, "naive_relevancy": 0.75, "naive_golden_coverage": 1.0, "graph_faithfulness": 0.0, "graph_relevancy": 0.0, "graph_golden_coverage": 0.5}
    got = answers.contexts(graph, ix.nodes, one, [(1, "graphs")], names=ix.names).collect()
    assert {r["mode"] for r in got} == {"naive", "graph"} and all(sum(r["mode"] == m for r in got) <= 6 for m in ("naive", "graph"))


def test_extracted_payloads_merge(spark):
    chunks = spark.createDataFrame([("d.md", 1, "A is B"), ("d.md", 2, "B again"), ("d.md", 3, "broken")], "document string, idx int, chunk string")
    reply = {1: {"nodes": [{"id": "a", "name": "A", "quote": "A is"}, {"id": "b", "name": "B"}], "relations": [{"source": "a", "target": "b", "type": "part_of", "confidence": 0.4}]}, 2: {"nodes": [{"id": "b", "name": "Other", "desc": "late"}], "relations": [{"source": "A", "target": "b", "type": "part_of"}]}}

    def client():
        class Told:
            def complete(self, prompt, system=""):
                return next((json.dumps(r) for n, r in reply.items() if ("A is B", "B again")[n - 1] in prompt), "no object")

        return Told()

    rows = E.extract(chunks, client, [], retries=0)
    nodes, edges = E.payloads(rows)
    got = {r.id: (r.name, r.desc, r.difficulty, [(x.chunk_id, x.quote) for x in r.evidence_refs]) for r in nodes.collect()}
    assert got == {"a": ("A", "", 3, [("chunk-0001", "A is")]), "b": ("B", "late", 3, [("chunk-0001", ""), ("chunk-0002", "")])}
    assert [(r.source, r.confidence, len(r.evidence_refs)) for r in edges.collect()] == [("A", 1.0, 2)]
    assert rows.filter("error is not null").count() == 1


def test_suggestions(spark, graph, tmp_path):
    client = K.Scripted(['{"edges": [{"source": "b", "target": "a", "reason": "r"}, {"source": "a", "target": "a"}, {"source": "nowhere", "target": "a"}, "odd"]}'])
    payload, figures = E.suggest_prerequisites(graph, client)
    assert payload["relations"] == [{"source": "b", "target": "a", "type": "prerequisite_of", "confidence": 0.6, "note": "r"}] and figures == {"candidates": 1, "suggested": 1}
    path = X.write_staged(payload, str(tmp_path / "inbox"), "s")
    assert json.loads(open(path).read()) == payload
    (tmp_path / "n").mkdir()
    for name in ("b.md", ".c.md", "a.txt", "x.png"):
        (tmp_path / "n" / name).write_text("x")
    found, missing = X.resolve_inputs([str(tmp_path / "n"), path, "nowhere"])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.txt", "b.md", "s_triples.json"] and missing == ["nowhere"]


def test_client_errors(tmp_path):
    c = K.Config(base_url="http://[::1]:9/v1", model="m", max_retries=2)
    assert c.local() and K.Config(base_url="localhost:1/v1").local() and not K.Config(base_url="http://localhost.example/").local()
    for reply in ({}, {"data": [{"index": 0}]}, {"data": []}, {"data": [{"index": 0, "embedding": ["x"]}]}, {"data": None}):
        with pytest.raises(K.ClientError):
            K.HttpClient(c, lambda url, body, r=reply: r).embeddings(["t"])
    pauses, calls = [], []

    def busy(url, body):
        calls.append(url)
        error = K.ClientError("busy")
        error.retry = True
        raise error

    with pytest.raises(K.ClientError):
        K.HttpClient(c, busy, pauses.append).complete("x")
    assert len(calls) == 3 and pauses == [2, 4]


def test_small_operators(spark, graph, one):
    from conceptmill.operators import graph as G
    from conceptmill.operators import learner as L

    assert G.node(graph, "a").first().name == "Sets" and G.node(graph, "A").count() == 0
    assert G.find_shown(graph, "GRAPHS").first().id == "d" and G.find_shown(graph, " ").count() == 0
    assert {r.id: r.degree for r in G.shown_labels(graph, 3).collect()} == {"a": 3, "b": 4, "d": 4}
    assert [(r.domain, r.id) for r in G.target_list(graph).orderBy("domain", "place").collect()][:2] == [("cs", "d"), ("cs", "e")]
    p = {r.band: (r.ids, r.total, r.touched, r.avg_mastery) for r in L.profile(graph.nodes, one).collect()}
    assert p["learning"] == (["b", "c"], 7, 3, 0.633) and p["weak"][0] == [] and len(p) == 5
    m = X.web_meta(graph, one).first()
    assert (m.nodes, m.edges, m.domains, m.roots, m.isolated, m.mean_mastery) == (7, 8, 3, 1, 1, 0.271429)
    assert V.unit_weights(spark.createDataFrame([(1, "a a b")], "k int, t string"), "k", "t").count() == 2
