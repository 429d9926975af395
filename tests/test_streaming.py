import datetime as dt

from conceptmill.operators.learner import mastery_from_log
from conceptmill.streaming import evidence as E

LOG = [(1, "c", 1, "add", 0.6, "2024-06-30"), (1, "c", 2, "add", 0.5, "2024-06-30"), (1, "c", 3, "revoke_last", None, None), (1, "c", 4, "revoke_last", None, None), (1, "c", 5, "revoke_last", None, None), (1, "c", 6, "add", 0.4, "2024-06-30"), (2, "c", 7, "add", 0.6, "2024-05-01"), (2, "c", 8, "add", 0.6, "2024-06-30")]


def test_fold_takes_back_the_newest(spark):
    got = {r.seq: r.revoked for r in E.folded(spark.createDataFrame(LOG, E.LOG)).collect()}
    assert got == {1: True, 2: True, 6: False, 7: False, 8: False}


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((LOG[:3], LOG[3:])):
        spark.createDataFrame(part, E.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.append(E.read_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (3, 8)[i]
    log = E.folded(spark.read.parquet(str(tmp_path / "out")))
    assert {r.user_id: r.mastery for r in mastery_from_log(log, "2024-06-30").collect()} == {1: 0.4, 2: 0.72}


def test_windows(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([(t(1, 0), "a", 1.0, 1), (t(1, 20), "a", 2.0, 1), (t(2, 30), "a", 4.0, 1)], "ts timestamp, event_type string, value double, user_id int")
    assert sorted((r.hour.hour, r.n, r.total) for r in E.tumbling(df).collect()) == [(1, 2, 3.0), (2, 1, 4.0)]
    assert sorted(r.n for r in E.sessions(df).collect()) == [1, 2]
