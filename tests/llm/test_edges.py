"""Null keys, clashing names, texts beyond a step's bytes and one hot group, for every operator that has not met them elsewhere."""

import random

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, SCHEMA, rows, sha
from pyspark.sql import functions as F
from test_decontam import brute as overlap
from test_decontam import digest as overlap_digest
from test_models import check_shards, encoding
from test_simhash import brute as fingerprints
from test_suffix import brute as repeated
from test_suffix import digest

from conceptmill.llm import bpe, decontam, langid, quality, queries, secrets, sharding, simhash, suffix, toxicity

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)
CLASH = ["1 as score", "2 as shard", "3 as token_ids", "4 as simhash", "5 as n_words", "6 as lang_pred", "7 as toxic_spans", "8 as digest", "9 as kept", "10 as secret_spans", "11 as grp", "12 as `size`"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows with two null keys and columns named like the operators' own."""
    return spark.createDataFrame([*AWKWARD, (None, "no key", "en", "s", 6), (None, "no key", "en", "s", 6)], SCHEMA).selectExpr("*", *CLASH)


def long_text(seed, size=1_400_000):
    rng = random.Random(seed)
    words = [f"word{rng.randrange(3000)}" for _ in range(size // 8)]
    return " ".join(words)


def test_sharding(spark, odd):
    got = sharding.assign(odd, 3).collect()
    assert len(got) == len(AWKWARD) + 2 and len({(r.shard, r.slot) for r in got}) == len(got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    hot = [(k, "the same text" if k % 3 else f"text {k}") for k in range(900)]
    check_shards(sharding.assign(spark.createDataFrame(hot, "doc_id long, text string"), 5).collect(), dict(hot), 5)


def test_scores_and_languages(spark, odd):
    model = langid.train(spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string"))
    got = langid.predict(odd, model, keep=["doc_id", "shard"])
    assert got.count() == len(AWKWARD) + 2 and {r.shard for r in got.collect()} == {2} and all(0 <= r.score <= 1 for r in got.collect())
    # A tie of cross-entropies: two languages learned from the same texts; always the first by name.
    same = langid.train(spark.createDataFrame([(k, "one text for both", x) for k, x in enumerate(["zz", "aa"])], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "text for")], "doc_id long, text string"), same).collect()} == {"aa"}
    big = spark.createDataFrame([(1, long_text(1)), (2, "der Hund " * 200_000), (3, "the cat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(big, model).collect()}[2] == "de"
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0))
    scored = toxicity.score(odd, field, keep=["doc_id", "shard"]).collect()
    assert len(scored) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 and r.shard == 2 for r in scored)
    assert toxicity.score(big, field).count() == 3


def test_tokens(spark, odd):
    e = encoding()
    got = bpe.encode(odd, VOCABULARY, keep=["doc_id", "text", "shard"])
    assert all(r.token_ids == e.encode_ordinary(r.text or "") and r.shard == 2 for r in got.collect()) and got.count() == len(AWKWARD) + 2
    big = long_text(2) + "  \n é漢" * 1000
    r = bpe.encode(spark.createDataFrame([(1, big), (2, "x" * 1_200_000)], "doc_id long, text string"), VOCABULARY, with_decoded=True).orderBy("doc_id").collect()
    assert r[0].token_ids == e.encode_ordinary(big) and sha(bytes(r[1].decoded)) == sha("x" * 1_200_000)


def test_every_code_point_is_split_as_by_the_library(spark):
    e = encoding()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b{c}{c}1{c}.{c} {c}z" for c in points[i : i + 1024]) for i in range(0, len(points), 1024)]
    df = spark.createDataFrame([*enumerate(texts)], "k long, text string").repartition(4)
    assert all(r.token_ids == e.encode_ordinary(texts[r.k]) for r in bpe.encode(df, VOCABULARY, keep=["k"]).collect())


def test_fingerprints_and_repeats(spark, odd):
    docs = [(1, long_text(3)), (2, long_text(3) + " end"), (3, "short text"), (4, long_text(4)[:1_050_000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(simhash.components(df).selectExpr("doc_id", "lower(lpad(hex(simhash), 16, '0'))", "component_id"))
    assert got == fingerprints(docs)
    assert digest(suffix.repeats(df)) == repeated(docs)
    assert simhash.components(odd).count() == suffix.repeats(odd).count() == len(AWKWARD) + 2
    # One passage in every text: one hot anchor for each place, one fingerprint group of copies.
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    hot = [(k, f"{k} {passage} {k * k}" if k % 2 else passage) for k in range(300)]
    assert digest(suffix.repeats(spark.createDataFrame(hot, "doc_id long, text string"))) == repeated(hot)


def test_native_operators_keep_every_row(odd):
    assert quality.judge(odd, []).count() == secrets.scan(odd).count() == len(AWKWARD) + 2
    assert secrets.scan(odd).select("doc_id", "shard", F.size("secret_spans")).count() == len(AWKWARD) + 2


def test_overlap_of_a_long_text(spark):
    docs = [(1, long_text(5)), (None, long_text(5)[:300])]
    items = [(1, long_text(5)[500_000:500_400]), (2, "nothing of this sort is there")]
    got = decontam.find_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert overlap_digest(got) == overlap(docs, items) and got.filter("size(hit_items) = 1").count() == 1
