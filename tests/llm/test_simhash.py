import random
import re

import xxhash
from helpers import AWKWARD, SCHEMA, SF, lower, rows

from conceptmill.llm import queries, simhash


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))
    changed = True
    near = [[j for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(docs))]
    while changed:
        changed = False
        for i in range(len(docs)):
            m = min(comp[j] for j in near[i])
            if m < comp[i]:
                comp[i], changed = m, True
    ids = {}
    for (k, _), c in zip(docs, comp, strict=True):
        ids[c] = min(ids.get(c, k), k)
    return sorted(((k, f"{p:016x}", ids[c]) for (k, _), p, c in zip(docs, prints, comp, strict=True)), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op6_simhash(spark, SF)) == brute(docs)


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    got = rows(simhash.components(df).selectExpr("doc_id", "lower(lpad(hex(simhash), 16, '0'))", "component_id"))
    assert got == brute([(r[0], r[1]) for r in AWKWARD])
    assert rows(simhash.components(df.limit(0))) == []
    stay = [r.doc_id for r in simhash.representatives(df).collect()]
    assert sorted(stay) == [1, 3, 4, 7, 8, 9, 10]


def test_clashing_columns_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c", 7), (2, "a b c", 8)], "doc_id long, text string, simhash int")
    assert sorted((r.doc_id, r.component_id) for r in simhash.components(df).collect() if r.doc_id) == [(2, 2)]
    assert simhash.representatives(df).columns == df.columns
    assert simhash.representatives(df).count() == 2


def test_links_are_exact(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {0, 2**64 - 1}
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "simhash long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_chains_become_one_component(spark):
    from conceptmill.llm.common import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 205), (300, 100)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in (100, 101, 205, 300)}


def test_components_of_large_ids(spark):
    from conceptmill.llm.common import connected_components

    top = 2**63 - 1
    edges = [(top - i, top - i - 1) for i in range(40)] + [(2**62 + i, 2**62 + 100) for i in range(40)] + [(-(2**63), -(2**63) + 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {top - i: top - 40 for i in range(41)} | {k: 2**62 for e in edges[40:80] for k in e} | {-(2**63): -(2**63), -(2**63) + 1: -(2**63)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Near-duplicates on five-word shingles


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_brute(docs):
    """Components of all pairs at similarity 0.8 or more, by the union of links."""
    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        comp[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: least[root(i)] for i, (k, _) in enumerate(docs)}, pairs


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_edited_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    docs, k = [], 0
    for _ in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        docs.append((k := k + 1, " ".join(words)))
        for share in (0.002, 0.01, 0.02, 0.05, 0.2):
            docs.append((k := k + 1, edited(rng, words, max(1, int(share * len(words))))))
    want, pairs = near_brute(docs)
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(want) and len(pairs) > 100
    assert all(want[c] == want[k] for k, c in got.items())  # never more than the links give
    assert sum(got[docs[i][0]] == got[docs[j][0]] for i, j in pairs) >= 0.97 * len(pairs)


def test_one_large_group_of_copies_of_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    docs = [(k, edited(rng, words, k % 5)) for k in range(600)] + [(1000, " ".join(f"v{i}" for i in range(80)))]
    df = spark.createDataFrame(docs + docs[:50], "doc_id long, text string")
    stay = [r.doc_id for r in simhash.near_representatives(df).collect()]
    assert sorted(stay) == [0, 0, 1000]


def test_forest_has_the_components_of_the_links():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(20):
        prints = np.repeat(rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64), 6, axis=0) ^ rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64)
        near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 50

        def parts(pairs):
            home = list(range(30))
            for a, b in pairs:
                x, y = home[a], home[b]
                home = [min(x, y) if h in (x, y) else h for h in home]
            return home

        links = simhash.forest(prints, 50)
        assert len(links) < 30 and parts(links) == parts(zip(*np.nonzero(near), strict=True))


def test_near_awkward_rows(spark):
    df = spark.createDataFrame([*AWKWARD, (None, "one", "en", "s", 3)], SCHEMA).selectExpr("*", "1 as stays", "2 as rep", "3 as bucket")
    got = rows(simhash.near_components(df).filter("doc_id is not null"))
    assert got == sorted(((r[0], near_brute([x[:2] for x in AWKWARD])[0][r[0]]) for r in AWKWARD), key=repr)
    out = simhash.near_representatives(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 3, 4, 7, 8, 9, 10] and out.filter("doc_id is null").count() == 1
    assert rows(simhash.near_components(df.limit(0))) == [] and simhash.near_representatives(df.limit(0)).count() == 0
    big = " ".join(f"w{i}" for i in range(300_000))
    far = spark.createDataFrame([(1, big), (2, big + " end"), (3, "short " * 5)], "doc_id long, text string")
    assert sorted(rows(simhash.near_components(far))) == [(1, 1), (2, 1), (3, 3)]


def test_pairs_at_the_threshold_are_all_found(spark):
    rng = random.Random(12)
    line = " ".join(f"c{i}" for i in range(24))
    docs, k = [], 0
    for i in range(250):
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        other = [*words[:24], "new", *words[25:]]  # 40 shingles of 50: exactly 0.8
        below = [*words[:16], "one", *words[17:32], "two", *words[33:]]
        for text in (words, other, below if i % 2 else words[::-1]):
            docs.append((k := k + 1, " ".join(text) + (" " + line) * (i % 5 == 0)))
    want, pairs = near_brute(docs)
    assert len(pairs) >= 250 and len(set(want.values())) > 400
    assert {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_prefixes_of_similar_sets_meet_in_any_order():
    import numpy as np

    rng = np.random.default_rng(6)
    for size in (1, 2, 4, 5, 9, 10, 15, 40, 45):
        for _ in range(30):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.uint64))
            a, b = pool[:size], np.append(pool[size // 9 : size], pool[size : size + rng.integers(0, size // 9 + 1)])
            picked = np.sort(rng.choice(pool, len(pool) // 3, replace=False))
            common = picked, rng.permutation(len(picked)) + 1
            first = [set(simhash.prefixes(x, np.zeros(len(x), np.int64), 1, common)[0].tolist()) for x in (a, b)]
            assert simhash.similarity(a, b) < 0.8 or first[0] & first[1]
