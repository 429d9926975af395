"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives windows of consecutive words. A window's words are ordered by rarity
over the corpus; containment of the whole window needs its prefix of one, the rarest word, so
windows are listed under that word. Documents send, for each of their own windows that may be one
of the benchmark's, a row for each word in it that may be a rarest one. Both sides meet in one
shuffled join on the word, with the length and positional bounds (as many words, the word at the
same place), and are verified byte by byte. What may be a window or a rarest word is told by two
bitmaps of a fixed size, so nothing that is broadcast grows with the benchmark, and the corpus is
read twice for any benchmark: to count its words, and to send its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, string_chunks, without

#: Consecutive words in a window.
WINDOW = 10
#: Bits of each bitmap, as a power of two: 8 MB are broadcast, however large the benchmark is.
MAP_BITS = 26
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 1 << 20
#: Documents with hits are joined back by broadcast up to this many bytes of them, else by a merge join.
BROADCAST_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Powers that a process keeps; those for a longer text are made for it alone.
_KEPT_POWERS = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        p = np.full(max(n, (1 << 20) + (1 << 18)), base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= _KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


class Words:
    """The words of some texts: byte bounds, a 64-bit hash of each, and each text's word bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes = _LOWER[data]
        inside = _WORD[self.bytes]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        power, inverse = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
        self._run, self._inverse = run, inverse
        self.hash = self._hashed(self.stop)

    def _hashed(self, stop: np.ndarray) -> np.ndarray:
        h = (self._run[stop] - self._run[self.start]) * self._inverse[self.start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def prefix_hash(self, size: int) -> np.ndarray:
        """A hash of each word's first bytes, unlike the words' own hashes; 0 for shorter words."""
        stop = self.start + size
        fits = stop <= self.stop
        return np.where(fits, self._hashed(np.minimum(stop, self.stop)) * np.uint64(2 * size + 1) + np.uint64(size), np.uint64(0))

    def text(self, first: int, count: int) -> bytes:
        raw = self.bytes
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[first : first + count], self.stop[first : first + count], strict=True))


    def windows(self, size: int) -> np.ndarray:
        """A hash of every ``size`` consecutive words, by the first; they may cross texts."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.hash) + 1)
        run = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * power[: len(self.hash)], out=run[1:])
        h = (run[size : size + n] - run[:n]) * inverse[:n] + np.uint64(size)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Lookup:
    """Positions in a sorted array of hashes, behind a bitmap that turns most words away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(keys >> np.uint64(46)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are keys, their places among the keys)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(46)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[maybe]
        return maybe[hit], place[hit]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, window hash, text, word hashes) of every window of every item."""
    for batch in batches:
        for part, data, offsets in string_chunks(batch, "text"):
            words = Words(data, offsets)
            n = np.diff(words.bounds)
            size = np.minimum(n, WINDOW)
            count = np.where(n > 0, n - size + 1, 0)
            item = np.repeat(np.arange(len(n)), count)
            first = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + words.bounds[item]
            size = size[item]
            hashes = np.zeros(len(item), np.uint64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                hashes[at] = words.windows(s)[first[at]]
            texts = [words.text(a, s) for a, s in zip(first.tolist(), size.tolist(), strict=True)]
            bounds = np.concatenate(([0], np.cumsum(size)))
            inner = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.hash[inner].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item)), pa.array(size.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(texts, pa.binary()), lists], names=["item", "n", "window", "text", "words"])


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a bitmap."""
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64), (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap of MAP_BITS bits with two bits set for each hash; at most so many come to the driver, packed."""
    h = F.col(column)
    spots = F.array(F.shiftrightunsigned(h, 64 - MAP_BITS), h.bitwiseAND(F.lit((1 << MAP_BITS) - 1)))
    each = rows.select(F.explode(spots).alias("p")).distinct()
    packed = each.groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in packed:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["k"] << 12 : (r["k"] << 12) + len(part)] = part[: len(out)]
    return out


def _listed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap may hold."""
    one, two = _places(hashes)
    at = np.flatnonzero(bits[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    two = two[at]
    return at[(bits[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]


def word_counts(docs: DataFrame, listed: np.ndarray, text: str = "text") -> DataFrame:
    """(word, n): occurrences over all documents of the words that a bitmap lists; summed in the tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for batch in batches:
            for _, data, offsets in string_chunks(batch, text):
                hashes = Words(data, offsets).hash
                own, n = np.unique(hashes[_listed(shared.value, hashes)], return_counts=True)
                words, back = np.unique(np.concatenate((words, own)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, n)), len(words)).astype(np.int64)
                if len(words) > HELD_WORDS:
                    yield rows()
                    words, counts = words[:0], counts[:0]
        yield rows()

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sender(windows, rare, sizes: list[int], text: str, kept: list[str], names: list[str]):
    """Adds n_words and sent, the rows (start, n, word, place, window, text) of windows that may be the benchmark's."""
    kinds = [("start", pa.int64()), ("n", pa.int32()), ("word", pa.int64()), ("place", pa.int32()), ("window", pa.int64()), ("text", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in string_chunks(batch, text):
                words = Words(data, offsets)
                found = []
                for size in sizes:
                    hashes = words.windows(size)
                    first = _listed(windows.value, hashes)
                    doc = np.searchsorted(words.bounds, first, "right") - 1
                    inside = first + size <= words.bounds[doc + 1]
                    first, doc = first[inside], doc[inside]
                    for place in range(size):
                        at = _listed(rare.value, words.hash[first + place])
                        found.append((doc[at], first[at], np.full(len(at), size), words.hash[first[at] + place], np.full(len(at), place), hashes[first[at]]))
                doc, first, size, word, place, window = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
                order = np.argsort(doc, kind="stable")
                doc, first, size, word, place, window = (x[order] for x in (doc, first, size, word, place, window))
                texts = [words.text(a, n) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                values = [first - words.bounds[doc], size, word.astype(np.uint64).view(np.int64), place, window.astype(np.uint64).view(np.int64), texts]
                rows = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)], names=[n for n, _ in kinds])
                bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows))))
                given = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*given, pa.array(np.diff(words.bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)], names=names)

    return run


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's overlapping occurrences as runs of words."""
    for batch in batches:
        out = []
        for starts in batch.column(1).to_pylist():
            runs: list[dict] = []
            for s in sorted(starts, key=lambda s: (s["start"], s["n"])):
                stop = s["start"] + s["n"]
                if runs and s["start"] <= runs[-1]["stop"]:
                    runs[-1]["stop"] = max(runs[-1]["stop"], stop)
                else:
                    runs.append({"start": s["start"], "stop": stop})
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["row", "hit_spans"])


def prefixes(benchmark: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(windows listed under their rarest word, (text, item) of every window); benchmark(item, text)."""
    raw = checkpointed(benchmark.mapInArrow(_item_windows, "item string, n int, window long, text binary, words array<long>"))
    distinct = raw.groupBy("text").agg(F.min("n").alias("n"), F.min("window").alias("window"), F.min("words").alias("words"))
    each = distinct.select("text", "n", "window", F.posexplode("words").alias("place", "word"))
    counts = word_counts(docs, bitmap(each, "word"), text).select(F.col("word").alias("counted"), F.col("n").alias("times"))
    ranked = each.join(counts, F.col("word") == F.col("counted"), "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "place")).alias("r")
    listed = ranked.groupBy("text", "n", "window").agg(rarest).select("text", "n", "window", "r.word", "r.place")
    return checkpointed(listed), raw.select("text", "item").distinct()


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words (long), hit_spans (array of [start, stop) word runs) and hit_items (sorted strings).

    Words are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower
    case. Null or empty texts have no words; null, empty and repeated items are harmless (a null
    item_id reads "None"); an empty benchmark hits nothing. Repeated rows are treated alike. Columns
    named like the outputs are replaced; other names can not clash. A text is worked on whole, with
    memory of some 50 times its bytes. Two passes over the documents for any benchmark; documents
    move only to be joined with their hits, and not while these fit BROADCAST_BYTES.
    """
    spark = docs.sparkSession
    source = without(docs, "n_words", "hit_spans", "hit_items", "_sent", "_row")
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("None")).alias("item"), F.col(item_text).alias("text"))
    listed, owners = prefixes(items, source, text)
    sizes = sorted(r["n"] for r in listed.select("n").distinct().collect())  # WINDOW values at most
    windows, rare = (spark.sparkContext.broadcast(bitmap(listed, c)) for c in ("window", "word"))
    row = "struct<start:long,n:int,word:long,place:int,window:long,text:binary>"
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("_sent", T._parse_datatype_string(f"array<{row}>"))])
    # The checkpoint freezes the rows, so that their numbers hold in every later use.
    sent = checkpointed(source.mapInArrow(_sender(windows, rare, sizes, text, kept, schema.names), schema)).withColumn("_row", F.monotonically_increasing_id())
    rows = sent.filter(F.size("_sent") > 0).select(F.col("_row").alias("row"), F.explode("_sent").alias("s")).select("row", "s.*")
    same: list[Column] = [rows[c] == listed[c] for c in ("word", "n", "place", "window", "text")]
    met = checkpointed(rows.hint("merge").join(listed, same).select("row", "start", rows["n"], rows["text"]).distinct())
    spans = met.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("starts")).mapInArrow(_span_rows, "row long, hit_spans array<struct<start:long,stop:long>>")
    named = met.select("row", "text").distinct().join(owners, "text").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("hit_items"))
    hits = checkpointed(spans.join(named, "row").withColumnRenamed("row", "_hit"))
    size = hits.agg(F.coalesce(F.sum(64 + 16 * F.size("hit_spans") + F.octet_length(F.array_join("hit_items", ",,,,"))), F.lit(0))).first()[0]
    small = F.broadcast(hits) if size <= BROADCAST_BYTES else hits.hint("merge")
    none = "array<struct<start:long,stop:long>>", "array<string>"
    return sent.join(small, F.col("_row") == F.col("_hit"), "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.coalesce("hit_spans", F.array().cast(none[0])).alias("hit_spans"),
        F.coalesce("hit_items", F.array().cast(none[1])).alias("hit_items"),
    )
