import re

from helpers import AWKWARD, SCHEMA, SF, lower, rows, sha

from conceptmill.llm import decontam, queries


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute(docs, items):
    windows = {}
    for k, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    sizes = {len(x) for x in windows}
    out = []
    for k, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def pairs(spark, name, key):
    return [(r[key], r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def test_query_equals_brute_force(spark):
    got = rows(queries.op10_decontamination(spark, SF))
    assert got == brute(pairs(spark, "documents", "doc_id"), pairs(spark, "benchmark", "item_id"))
    assert any(r[-1] for r in got)


def digest(df):
    return rows(df.selectExpr("doc_id", "n_words", "aggregate(hit_spans, 0L, (n, s) -> n + s.stop - s.start)", "size(hit_items)", "sha2(array_join(hit_items, ','), 256)", "size(hit_spans) > 0"))


ITEMS = [(1, "Same text, here!"), (2, ""), (3, None), (4, "word " * 12), (5, "text here again and"), (6, "ÉÑ é漢字"), (7, "Same text, here!"), (10, "one")]


def test_awkward_rows(spark, monkeypatch):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in AWKWARD], ITEMS)
    assert digest(decontam.find_overlap(df, bench)) == want
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert digest(decontam.find_overlap(df, bench)) == want
    assert digest(decontam.find_overlap(df.limit(0), bench)) == []
    assert all(not r[-1] for r in digest(decontam.find_overlap(df, bench.limit(0))))
    clash = df.selectExpr("*", "1 as n_words", "'x' as hit_items", "2 as word", "3 as start", "4 as `row`", "5 as n")
    out = decontam.find_overlap(clash, bench)
    assert digest(out) == want and out.columns == [*SCHEMA_NAMES, "word", "start", "row", "n", "n_words", "hit_spans", "hit_items"]


SCHEMA_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_null_keys_long_texts_and_a_hot_window(spark):
    passage = "the quick brown fox jumps over the lazy dog today"
    filler = " ".join(f"w{i % 5000}" for i in range(250_000))  # over a step's bytes
    docs = [(None, passage), (1, filler + " " + passage + " " + filler), (2, passage.replace("fox", "cat")), *[(k, f"x{k} {passage} y") for k in range(3, 300)]]
    items = [(1, "so " + passage), (None, passage), (2, passage + " " + passage)]
    got = digest(decontam.find_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, [("None" if k is None else k, t) for k, t in items])


def test_two_passes_for_any_benchmark(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = [(k, f"text number {k} of some that hold words like w{k} and {k * k}") for k in range(50)]
    for size in (3, 400):
        df = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
        items = [(k, f"item {k} number {k} of some that hold words like w{k} and {k * k} " + "more " * k) for k in range(size)]
        before = read.value
        assert digest(decontam.find_overlap(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
        assert read.value - before == 2 * len(docs)
