from conceptmill.plans.tools import Session
from conceptmill.sources.files import STATES


def test_session(spark, graph):
    rows = [{"user_id": "me", "concept_id": c, "mastery": m, "confidence": 0.3, "evidence": [], "last_touched": None, "source": ""} for c, m in (("a", 0.9), ("b", 0.6), ("c", 0.4))]
    s = Session(graph, spark.createDataFrame(rows, STATES), "2024-06-30")
    p = s.get_learner_profile()
    assert (p["total"], p["touched"], p["avg_mastery"]) == (7, 3, 0.633) and p["bands"]["learning"]["ids"] == ["b", "c"]
    assert s.get_learner_profile("life")["touched"] == 0
    assert s.check_readiness("Paths") == {"target": "e", "verdict": "not_ready", "gaps": ["d"], "reviews": ["c"], "ok": ["b", "a"]}
    assert [x["id"] for x in s.get_learning_path("routes")["steps"]] == ["a", "b", "c", "d", "e"]
    assert s.recommend_next(1)[0]["id"] == "b"
    q = s.query_node("maps")
    assert q["node"]["id"] == "b" and [x["id"] for x in q["unlocks"]] == ["d"] and [x["id"] for x in q["confusable"]] == ["f"]
    assert [x["domain"] for x in s.list_domains()] == ["math", "cs", "life"]
    assert "error" in s.query_node("zzz") and "error" in s.update_mastery("Tea", "gossip")
    assert s.update_mastery("Tea", "quiz", weight=0.6)["mastery"] == 0.6
    assert s.update_mastery("Tea", "quiz", weight=0.6)["mastery"] == 0.84
    assert s.update_mastery("Tea", revoke_last=True)["mastery"] == 0.6
    assert s.update_mastery("Tea", revoke_last=True)["mastery"] == 0.0
    assert "error" in s.update_mastery("Tea", revoke_last=True)
    found = s.search_knowledge("graphs", max_context=4)
    assert found["nodes"][0]["id"] == "d" and found["context_text"].startswith("[seed]")
