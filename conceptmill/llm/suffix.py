"""Removal of repeated byte strings by suffix sorting, sharded by content so that no shard holds the corpus.

Two equal strings of LENGTH bytes select the same anchor, the smallest hash among their GRAM-byte
grams, at the same place. Runs of string starts that select one anchor are rows; an anchor that
occurs once cannot start a repetition, so only runs of repeated anchors travel with their bytes.
Runs meet by anchor. A shard is worked off in blocks of whole anchors: runs equal as a whole fall
away first, the rest is ordered by induced sorting with common-prefix values (see induced.py), and
of every class of suffixes with a common prefix of LENGTH bytes all but the earliest are marked.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import string_chunks
from .decontam import _powers
from .induced import Scratch, pieces, repeated

#: Bytes of a string that may not repeat, and of the grams that anchors are chosen from.
LENGTH, GRAM = 100, 32
STEP_BYTES = 1 << 20
#: Bytes of runs that are suffix-sorted together; whole anchors stay together, so one anchor may exceed
#: them by far. Beyond SPOOL_BYTES a block's runs wait in a scratch file, and its sort is external.
BLOCK_BYTES, SPOOL_BYTES = 4 << 20, 64 << 20
#: Bytes of runs that a block remembers, to answer an equal run without sorting it.
SEEN_BYTES = 64 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes."""
    power, inverse = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
    n = len(data) - size + 1
    return _mixed((run[size : size + n] - run[:n]) * inverse[:n])


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of every ``width`` neighbours, by doubling."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:n], x[width - span : width - span + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start, 1 or 2) of the runs of string starts with one anchor.

    Starts count within the text. The last is 2 if the text has the anchor in several places:
    then one run alone can repeat itself.
    """
    n = len(data) - LENGTH + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n <= 0:
        return none
    low, width = rolling(data, GRAM), LENGTH - GRAM + 1
    least = _slide(low, width, np.minimum)
    chosen = np.flatnonzero(low == _slide(np.pad(least, width - 1), width, np.maximum))
    mark = lambda text, value: value ^ _mixed(text.astype(np.uint64) + np.uint64(1))
    places, times = np.unique(mark(np.searchsorted(offsets, chosen, "right") - 1, low[chosen]), return_counts=True)
    start = np.arange(n)
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[text + 1]
    start, text, least = start[inside], text[inside], least[inside]
    if not len(start):
        return none
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(new[1:], len(start)) - 1
    # Longer runs have the anchor in several places; they are cut, so that rows stay short.
    pieces = -(-(last - new + 1) // width)
    at = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    end = np.repeat(last, pieces)
    new = np.repeat(new, pieces) + at * width
    last = np.minimum(new + width - 1, end)
    text, anchor = text[new], least[new]
    many = np.minimum(times[np.searchsorted(places, mark(text, anchor))], 2)
    return text, anchor.view(np.int64), start[new] - offsets[text], start[last] - offsets[text], many


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, first_key, nth, run): a run packs its first start, its length and whether it can repeat itself."""
    for batch in batches:
        for part, data, offsets in string_chunks(batch, "text", STEP_BYTES):
            text, anchor, first, last, many = anchors(data, offsets)
            run = first << 9 | (last - first) << 2 | many
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(at), part.column(1).take(at), pa.array(run)], names=["anchor", "first_key", "nth", "run"])


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, those whose anchor is repeated; the last row waits for the next batch."""
    held, held_again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        anchor = rows.column(0).to_numpy()
        again = (rows.column(3).to_numpy() & 3) > 1
        same = anchor[1:] == anchor[:-1]
        again[1:] |= same
        again[:-1] |= same
        again[0] |= held_again
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(again[:-1]))
        held, held_again = rows.slice(rows.num_rows - 1), bool(again[-1])
    if held is not None and held_again:
        yield held


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "first_key", "nth", "first", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for row in batch.to_pylist():
            raw = row["text"].encode()
            out = [(r["anchor"], row["first_key"], row["nth"], r["run"] >> 9, raw[r["run"] >> 9 : (r["run"] >> 9) + (r["run"] >> 2 & 127) + LENGTH]) for r in row["runs"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class _Block:
    """Runs of whole anchors: those equal to an earlier run are answered at once, the others are suffix-sorted.

    The runs' bytes wait in memory up to a bound, then in a scratch file; a run that is not among
    the remembered ones is sorted, which gives the same answer.
    """

    def __init__(self) -> None:
        self.out: list[tuple[int, int, int, int]] = []
        self._empty()

    def _empty(self) -> None:
        self.raw, self.file, self.size, self.held = bytearray(), None, 0, 0
        self.seen: set[bytes] = set()
        self.meta = [array("q") for _ in range(4)]  # key, nth, first start, bytes

    def add(self, key: int, nth: int, first: int, raw: bytes) -> None:
        if raw in self.seen:
            self.out.append((key, nth, first, first + len(raw)))
            return
        if self.held + len(raw) <= SEEN_BYTES:
            self.seen.add(raw)
            self.held += len(raw)
        for column, value in zip(self.meta, (key, nth, first, len(raw)), strict=True):
            column.append(value)
        self.raw += raw
        self.size += len(raw)
        if len(self.raw) > SPOOL_BYTES:
            self._spool()

    def _spool(self) -> None:
        if self.file is None:
            self.file = Scratch().file()
        self.file.write(self.raw)
        self.raw = bytearray()

    def sort(self) -> Iterator[pa.RecordBatch]:
        """The byte ranges that repeat, in pieces; then the block is empty."""
        if self.file is None:
            data = np.frombuffer(bytes(self.raw), np.uint8)
        else:
            self._spool()
            self.file.flush()
            data = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
        key, nth, start, size = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in self.meta)
        offsets = np.concatenate(([0], np.cumsum(size)))
        again = repeated(data, offsets, LENGTH)
        for s in pieces(len(data)):
            hit = np.flatnonzero(again[s]) + s.start
            if not len(hit):
                continue
            row = np.searchsorted(offsets, hit, "right") - 1
            cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(row) > 0))
            begin, end, row = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)], row[np.append(0, cut + 1)]
            shift = start[row] - offsets[row]
            yield _range_rows(key[row], nth[row], begin + shift, end + shift + LENGTH)
        self._empty()

    def take(self) -> pa.RecordBatch:
        columns = [*zip(*self.out, strict=True)] or [(), (), (), ()]
        self.out = []
        return _range_rows(*columns)


def _range_rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["p_key", "p_nth", "start", "stop"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of strings met before; rows come sorted by anchor, first key, nth and place."""
    block, last = _Block(), None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for anchor, key, nth, first, raw in zip(*columns, strict=True):
            if last is not None and anchor != last[0] and block.size >= BLOCK_BYTES:
                yield from block.sort()
            if (anchor, key, nth, first) != last:  # a repeated row is the same document
                block.add(key, nth, first, raw)
            last = anchor, key, nth, first
        yield block.take()
    yield from block.sort()
    yield block.take()


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            raw = (row["text"] or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["start"], r["stop"]) for r in row["ranges"] or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            if row["copy"] and len(raw) >= LENGTH:
                spans = [[0, len(raw)]]
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((row["key"], len(raw), [{"start": a, "stop": b} for a, b in spans], kept.hexdigest()))
        columns = [*zip(*out, strict=True)] or [()] * 4
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], span_type), pa.array(columns[3], pa.string())], names=["key", "n_bytes", "removed", "kept_sha256"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed (array of byte [start, stop)), kept_sha256) for every row of docs.

    A byte is removed if a string of LENGTH bytes over it also starts earlier: in a smaller key,
    or earlier in the same text. Null and short texts lose nothing. A text equal to one with a
    smaller key is removed whole; equality is that of SHA-256 digests. Rows that repeat key and text
    are one document with one result each; a null key sorts before all others; one key over several
    texts orders them by digest. An empty table gives an empty table; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    order_key = F.coalesce("key", F.lit(-(2**63)))
    rows = docs.select(F.col(key).cast("long").alias("key"), body.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # A distinct text is named by its smallest key and its place among the texts that share it: 12 bytes, mostly zeros.
    firsts = rows.groupBy("digest").agg(F.min(order_key).alias("first_key"))
    firsts = firsts.select(F.col("digest").alias("f_digest"), "first_key", (F.row_number().over(Window.partitionBy("first_key").orderBy("digest")) - 1).alias("nth"))
    # Every use of the texts joins them by digest with a small side, over one and the same exchange.
    whole = rows.join(firsts.hint("merge"), F.col("digest") == F.col("f_digest"))
    # Not an equation: as one it would become a join key and ask for an exchange of its own.
    texts = whole.filter(order_key <= F.col("first_key"))
    found = texts.select("first_key", "nth", "text").mapInArrow(_anchor_rows, "anchor long, first_key long, nth int, run long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = found.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeated_anchors, found.schema)
    runs = again.groupBy(F.col("first_key").alias("r_key"), F.col("nth").alias("r_nth")).agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))
    wanted = runs.join(firsts, (F.col("r_key") == F.col("first_key")) & (F.col("r_nth") == F.col("nth"))).select(F.col("f_digest").alias("r_digest"), "first_key", "nth", "runs")
    held = rows.join(wanted.hint("merge"), F.col("digest") == F.col("r_digest")).filter(order_key <= F.col("first_key"))
    contexts = held.select("text", "first_key", "nth", "runs").mapInArrow(_context_rows, "anchor long, first_key long, nth int, first long, bytes binary")
    ranges = contexts.repartition(parts, "anchor").sortWithinPartitions("anchor", "first_key", "nth", "first").mapInArrow(_repeats, "p_key long, p_nth int, start long, stop long")
    per_text = ranges.groupBy("p_key", "p_nth").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    small = firsts.join(per_text, (F.col("first_key") == F.col("p_key")) & (F.col("nth") == F.col("p_nth")), "left").select("f_digest", "first_key", "ranges")
    marked = rows.join(small.hint("merge"), F.col("digest") == F.col("f_digest"))
    out = marked.select("key", "text", "ranges", (order_key > F.col("first_key")).alias("copy")).mapInArrow(_removals, "key long, n_bytes long, removed array<struct<start:long,stop:long>>, kept_sha256 string")
    return out.withColumnRenamed("key", key)
