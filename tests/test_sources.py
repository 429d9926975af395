import json

import pytest

from conceptmill.operators import extract as E
from conceptmill.operators.graph import is_acyclic
from conceptmill.sources import connector as K
from conceptmill.sources import files as X

BASE = {"nodes": [{"id": "a", "name": "A", "type": "Concept"}, {"id": "b", "name": "B", "type": "Tool", "difficulty": 2, "aliases": ["bee"]}], "relations": [{"source": "a", "target": "b", "type": "prerequisite_of"}]}


def test_layers_and_round_trips(spark, tmp_path):
    base, patch = tmp_path / "base.json", tmp_path / "patch.yaml"
    base.write_text(json.dumps(BASE))
    assert X.write_patch(str(patch), [{"id": "a", "desc": "first"}], [{"source": "a", "target": "b", "type": "prerequisite_of", "confidence": 0.5}])
    assert not X.write_patch(str(patch), [], [])
    g = X.read_layers(spark, str(base), str(patch), str(tmp_path / "missing.yaml"))
    assert {r.id: r.desc for r in g.nodes.collect()} == {"a": "first", "b": ""}
    assert [r.confidence for r in g.edges.collect()] == [0.5] and is_acyclic(g)
    X.write_sqlite(g, str(tmp_path / "g.db"))
    back = X.read_sqlite(spark, str(tmp_path / "g.db"))
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, g.nodes.collect()))
    with pytest.raises(FileNotFoundError):
        X.read_layers(spark, str(tmp_path / "none.yaml"))
    base.write_text(json.dumps({"nodes": [{"id": "a", "name": "A", "type": "Nonsense"}]}))
    with pytest.raises(ValueError):
        X.read_layers(spark, str(base))


def test_learner_payload_eval(spark, tmp_path):
    path = tmp_path / "learner.json"
    assert X.read_learner(spark, str(path)).count() == 0
    path.write_text(json.dumps({"user_id": "me", "states": {"a": {"mastery": 0.4, "evidence": [{"type": "quiz", "weight": 0.2}]}, "k": {"concept_id": "b", "mastery": 1}}}))
    s = X.read_learner(spark, str(path))
    X.write_learner(s, str(path))
    assert sorted(map(tuple, X.read_learner(spark, str(path)).collect())) == sorted(map(tuple, s.collect()))
    assert (tmp_path / "learner.json.bak").exists()
    p = tmp_path / "p.json"
    p.write_text(json.dumps(BASE | {"source": "notes"}))
    n, e, source = X.read_payload(spark, str(p))
    assert (n.count(), e.count(), source) == (2, 1, "notes")
    p.write_text(json.dumps([{"query": "q", "golden": ["a"]}]))
    assert X.read_eval(spark, str(p)).first().golden == ["a"]


def test_notes_index_and_web(spark, graph, one, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("# H\nbody")
    (tmp_path / "n/.hidden.md").write_text("# H\nbody")
    (tmp_path / "n/bad.docx").write_bytes(b"no zip")
    rows = X.read_notes(spark, str(tmp_path / "n")).collect()
    assert sorted((r.title, bool(r.error)) for r in rows) == [("", True), ("H", False)]
    v = spark.createDataFrame([("a", 0, [1.0])], "id string, ord long, vector array<double>")
    X.write_index(v, v, "sig", str(tmp_path / "ix"))
    assert X.read_index(spark, str(tmp_path / "ix"), "sig")[0].count() == 1
    assert X.read_index(spark, str(tmp_path / "ix"), "other") is None and X.read_index(spark, str(tmp_path / "no"), "sig") is None
    nodes, links = X.web_payload(graph, one)
    assert json.loads(nodes.first().json)["band"] == "mastered" and links.count() == 8


def test_config_and_client(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("base_url: http://localhost:1/v1\nmodel: ${MY_MODEL}\ntemperature: 0\n")
    monkeypatch.setenv("MY_MODEL", "m1")
    monkeypatch.setenv("LLM_MODEL", "env")
    c = K.load_config(str(path), max_tokens=5)
    assert (c.model, c.temperature, c.max_tokens, c.embedding_base_url) == ("m1", 0.0, 5, "http://localhost:1/v1")
    monkeypatch.delenv("LLM_MODEL")
    with pytest.raises(K.ConfigError):
        K.load_config(None, base_url="http://far.example")
    assert K.endpoint("http://x/v1/chat/completions", "/chat/completions") == K.endpoint("http://x/v1/", "/chat/completions")
    error = K.ClientError("busy")
    error.retry = True
    replies = [error, {"choices": [{"message": {"content": "hi"}}]}]

    def send(url, body):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert K.HttpClient(c, send, lambda s: None).complete("x") == "hi"
    vectors = K.HttpClient(c, lambda u, b: {"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}).embeddings(["a", "b"])
    assert vectors == [[0.6, 0.8], [0.0, 1.0]]


def test_extraction(spark):
    ok = '{"nodes": [{"id": "n", "name": "N", "quote": "real words"}, {"id": "m", "quote": "invented"}], "relations": []}'
    more = '{"nodes": [{"id": "n"}, {"id": "k"}], "relations": [{"source": "n", "target": "k", "type": "part_of"}]}'
    client = K.Scripted(["garbage", ok, more])
    got = E.extract_one(client, "prompt", 1, 1)
    assert [n["id"] for n in got["nodes"]] == ["n", "m", "k"] and len(got["relations"]) == 1 and "could not be read" in client.prompts[1]
    refs = E.with_refs(got, "【笔记位置：A > B】\nsome real words", "dir/doc.md", 1)["nodes"]
    assert refs[0]["evidence_refs"][0]["quote"] == "real words" and refs[0]["evidence_refs"][0]["section"] == "A > B"
    assert refs[1]["evidence_refs"][0] == refs[0]["evidence_refs"][0] | {"quote": "", "quote_verified": False}
    chunks = spark.createDataFrame([("d", 1, "good"), ("d", 2, "bad"), ("d", 3, "over")], "document string, idx int, chunk string").coalesce(1)
    rows = E.extract(chunks, lambda: K.Scripted([ok, "x", "x"]), [], max_chunks=2).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.error is None) for r in rows] == [("chunk-0001", True), ("chunk-0002", False)]
    assert E.suggest([], K.Scripted(['{"edges": [{"source": "a", "target": "b", "reason": "r"}]}'])) == [{"source": "a", "target": "b", "type": "prerequisite_of", "confidence": 0.6, "note": "r"}]
    assert E.judge_answer(K.Scripted(["uses Alpha", '{"faithfulness": 3, "relevancy": "x"}']), "q", "c", ["Alpha", "Beta"]) == {"answer": "uses Alpha", "faithfulness": 1.0, "relevancy": 0.0, "golden_coverage": 0.5}
