from conceptmill.operators import learner as L
from conceptmill.sources.files import STATES

DAY = "2024-06-30"
OLD = "2024-05-01"  # 60 days earlier


def states(spark, mastery=0.0, evidence=(), last=None):
    ev = [{"type": "quiz", "desc": "", "weight": w, "ts": t, "revoked": r} for w, t, r in evidence]
    return spark.createDataFrame([{"user_id": "me", "concept_id": "c", "mastery": mastery, "confidence": 0.3, "evidence": ev, "last_touched": last, "source": ""}], STATES)


def value(df):
    return L.mastery(df, DAY).first().mastery


def test_decay_and_noisy_or(spark):
    assert value(states(spark, 0.8, last=OLD)) == 0.4
    assert value(states(spark, 0.8)) == 0.8
    assert value(states(spark, 0.8, last="not a date")) == 0.8
    assert value(states(spark, 0.8, last="2025-01-01")) == 0.8
    assert value(states(spark, 0.1, [(0.6, OLD, False), (0.6, DAY, False)])) == 0.72
    assert value(states(spark, 0.1, [(0.6, OLD, False), (0.6, DAY, True)])) == 0.3
    assert value(states(spark, 0.9, [(0.6, DAY, True)])) == 0.0
    assert value(states(spark, 0.9, [(0.6, None, False)], last=OLD)) == 0.3


def test_mark_appends_freezes_and_overrides(spark):
    two = L.mark(L.mark(states(spark).filter("false"), "me", "c", DAY, evidence=[("quiz", "", 0.6)]), "me", "c", DAY, evidence=[("quiz", "", 0.6)])
    assert value(two) == 0.84
    legacy = L.mark(states(spark, 0.8, last="2024-05-31"), "me", "c", DAY, evidence=[("quiz", "", 0.4)])
    assert 0.4 < value(legacy) < 0.88 and len(legacy.first().evidence) == 2
    aged = L.mark(states(spark, 0.0, [(0.6, OLD, False)]), "me", "c", DAY, evidence=[("code", "", 0.6)])
    assert value(aged) == 0.72
    scored = L.mark(two, "me", "c", DAY, score=0.5)
    assert value(scored) == 0.5 and [e.revoked for e in scored.first().evidence] == [True, True, False]


def test_profiles(spark, graph, one):
    rows = {r.band: r.n for r in L.band_profile(graph.nodes, one).collect()}
    assert rows == {"untouched": 4, "weak": 0, "learning": 2, "solid": 0, "mastered": 1}
    assert {r.domain: (r.n, r.untouched) for r in L.domain_overview(graph.nodes, one).collect()} == {"math": (4, 1), "cs": (2, 2), "life": (1, 1)}
    assert {r.band: r.names for r in L.text_summary(graph.nodes, one).collect()}["learning"] == "Logic, Maps"


def test_log_revocation(spark):
    log = spark.createDataFrame([(1, "c", 1, 0.6, OLD, False), (1, "c", 2, 0.6, DAY, False), (1, "c", 3, 0.9, DAY, True)], "user_id int, concept_id string, seq long, weight double, ts string, revoked boolean")
    assert L.mastery_from_log(log, DAY).first().mastery == 0.72
    assert L.latest_standing(log).first().seq == 2
    assert L.mastery_from_log(L.revoke_latest(log), DAY).first().mastery == 0.3
