import random

import numpy as np
import pytest

from conceptmill.llm import induced


def packed(records):
    return np.frombuffer(b"".join(records), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in records]))).astype(np.int64)


def brute(records, length):
    met, out = set(), []
    for r in records:
        for i in range(len(r)):
            s = r[i : i + length]
            out.append(len(s) == length and s in met)
            if len(s) == length:
                met.add(s)
    return out


@pytest.mark.parametrize("letters,length", [(b"ab", 3), (b"ab", 6), (b"a", 4), (b"abcd", 5), (bytes(range(256)), 2), (b"abn \xff\x00", 8)])
def test_repeats_equal_brute_force(letters, length, monkeypatch):
    rng = random.Random(length)
    for trial in range(40):
        records = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        records += rng.sample(records, len(records) // 2)
        data, offsets = packed(records)
        memory, piece = ((0, 3), (40, 7), (1 << 20, 1 << 20), (200, 1 << 20))[trial % 4]
        monkeypatch.setattr(induced, "PIECE", piece)
        scratch = induced.Scratch(memory)
        assert induced.repeated(data, offsets, length, scratch).tolist() == brute(records, length)
        assert scratch.spilled == 0 if memory == 1 << 20 else scratch.spilled > 0 or len(data) <= memory


def test_order_and_common_prefixes():
    rng = random.Random(7)
    for _ in range(60):
        records = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        data, offsets = packed(records)
        s = induced.Sorter(data, offsets, 100)
        starts, common = (np.concatenate(x) for x in zip(*s.order(), strict=True))
        texts = []
        for p in starts.tolist():
            end = p
            while s.text[end]:
                end += 1
            texts.append(bytes((s.text[p:end] - 1).astype(np.uint8)))
        assert sorted(starts.tolist()) == np.flatnonzero(s.text).tolist()
        assert texts == sorted(texts)
        for a, b, c in zip(texts, texts[1:], common[1:].tolist(), strict=False):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert c == n


def test_a_block_many_times_the_memory_bound(monkeypatch):
    """Records that share long passages, 60 times the bound in bytes of text alone; the result is that of memory."""
    rng = random.Random(11)
    passages = [bytes(rng.choice(b"abcdefgh ") for _ in range(300)) for _ in range(30)]
    records = []
    for _ in range(900):
        own = bytes(rng.choice(b"abcdefgh ") for _ in range(60))
        p = rng.choice(passages)
        at = rng.randrange(150)
        records.append(own + p[at : at + rng.randint(90, 150)])
    data, offsets = packed(records)
    want = induced.repeated(data, offsets, 100)
    assert want.any() and want.tolist() == brute(records, 100)
    monkeypatch.setattr(induced, "PIECE", 5000)
    scratch = induced.Scratch(len(data) // 60)
    assert (induced.repeated(data, offsets, 100, scratch) == want).all()
    assert scratch.spilled > 20 * len(data)


def test_external_ordering(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(induced, "PIECE", 64)
    for n, high in ((0, 5), (50, 5), (1000, 3), (1000, 10**9), (5000, 400)):
        keys = rng.integers(0, high, n)
        assert (induced.ordering(keys, induced.Scratch(0)) == np.argsort(keys, kind="stable")).all()
