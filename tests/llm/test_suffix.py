import hashlib

from helpers import AWKWARD, SCHEMA, SF, rows

from conceptmill.llm import queries, suffix


def brute(docs):
    met, out, whole = set(), {}, {}
    for key, text in sorted(set(docs), key=lambda d: (d[0], hashlib.sha256((d[1] or "").encode()).digest())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in met:
                gone[i : i + 100] = b"\1" * 100
            met.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key, text] = (key, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted((out[d] for d in docs), key=repr)


def digest(df):
    return rows(df.selectExpr("doc_id", "n_bytes", "aggregate(removed, 0L, (n, s) -> n + s.stop - s.start)", "size(removed)", "kept_sha256"))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(queries.op7_repeats(spark, SF))
    assert got == brute(docs)
    assert any(0 < r[2] < r[1] for r in got)


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    assert digest(suffix.repeats(df)) == brute([(r[0], r[1]) for r in AWKWARD])
    assert digest(suffix.repeats(df.limit(0))) == []
    odd = spark.createDataFrame([(None, "n" * 150, 1, 2), (1, "n" * 150, 1, 2), (1, "m" * 120 + "n" * 130, 1, 2), (1, "z" * 99, 1, 2), (1, "z" * 99, 1, 2)], "doc_id long, text string, digest int, first_key int")
    got = {(r[0], r[1]): r[2] for r in digest(suffix.repeats(odd))}
    assert got == {(None, 150): 149, (1, 150): 150, (1, 250): 249, (1, 99): 0}
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    docs = [(1, "x" + passage + "y"), (2, passage[:99]), (3, "ab" + passage[:100]), (4, passage + passage), (5, "é" * 80), (6, "zé" * 30 + "é" * 80)]
    assert digest(suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_a_hot_anchor_goes_through_the_scratch_files(monkeypatch):
    """A block whose runs share one anchor, with every bound far below its size."""
    import random

    import numpy as np
    import pyarrow as pa

    from conceptmill.llm import induced

    rng = random.Random(6)
    middle = "".join(rng.choice("abcdef") for _ in range(32))
    texts = ["".join(rng.choice("abcdef") for _ in range(60 if k % 3 else 75)) + middle + "".join(rng.choice("ab") for _ in range(12)) + "z" * 75 for k in range(400)]
    texts += [t[5:] for t in texts[::7]] + ["q" + t for t in texts[::11]]
    rows_ = [(1, k, 0, 0, t.encode()) for k, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["anchor", "first_key", "nth", "first", "bytes"])
    spilled = []

    class Watched(induced.Scratch):
        def __init__(self, memory=5000):
            super().__init__(memory)
            spilled.append(self)

    def ranges():
        out = {}
        for b in suffix._repeats(iter([batch.slice(0, 250), batch.slice(250)])):
            for r in b.to_pylist():
                out.setdefault(r["p_key"], set()).update(range(r["start"], r["stop"]))
        return out

    want = ranges()
    monkeypatch.setattr(induced, "Scratch", Watched)
    monkeypatch.setattr(induced, "PIECE", 3000)
    monkeypatch.setattr(suffix, "SPOOL_BYTES", 1000)
    monkeypatch.setattr(suffix, "SEEN_BYTES", 500)
    assert ranges() == want and sum(s.spilled for s in spilled) > 10 * sum(map(len, texts))
    met, brute_ = set(), {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 99):
            if t[i : i + 100] in met:
                brute_.setdefault(k, set()).update(range(i, i + 100))
            met.add(t[i : i + 100])
    assert want == brute_ and np.all([len(t) >= 100 for t in texts])
