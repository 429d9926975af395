"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Every byte gets a class from codepoint-class arrays, every class
is a transition function on the splitter's states, and the states at all positions come from an
associative scan: functions compose through the multiplication table of the transition monoid.
A boundary is a lookup by (state before, class). The resulting slices go through a cache; the
slices that miss are merged together, one lowest-ranked pair per slice and round.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_chunks, without

#: Slices kept in a worker's cache before it starts afresh, and bytes of text worked on at once.
CACHE_SLICES = 150_000
STEP_BYTES = 1 << 20
#: Longer slices are merged with a heap, one at a time.
LONG_SLICE = 400
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of a byte, as the splitter sees it.
CONT, LETTER, NUMBER, OTHER, SPACE, LAST, PREFIX, SHORT1, SHORT2, EDGE = range(10)
# States: between texts, in a run of one kind, after a prefixed space, 1 or 2 letters of a contraction left.
S_EDGE, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_PREFIX, S_ONE, S_TWO, S_DONE = range(9)
STATES = 9


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The splitter: (next state, does a token start here)."""
    if cls == CONT:
        return state, False
    if cls == EDGE:
        return S_EDGE, False
    if state == S_TWO:
        return S_ONE, False
    if state == S_ONE:
        return S_DONE, False
    if cls == PREFIX:
        return S_PREFIX, True
    if cls in (SPACE, LAST):
        return S_SPACE, cls == LAST or state != S_SPACE
    if cls in (SHORT1, SHORT2):
        if state in (S_OTHER, S_PREFIX):
            return S_OTHER, False
        return (S_ONE if cls == SHORT1 else S_TWO), True
    kind = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}[cls]
    return kind, state not in (kind, S_PREFIX)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(generator of a class, multiplication table, element x state -> state, state x class -> start)."""
    generators = [tuple(_step(s, c)[0] for s in range(STATES)) for c in range(10)]
    identity = tuple(range(STATES))
    elements, order = {identity: 0}, [identity]
    for g in generators:
        if g not in elements:
            elements[g] = len(order)
            order.append(g)
    at = 0
    while at < len(order):
        for g in generators:
            made = tuple(g[s] for s in order[at])
            if made not in elements:
                elements[made] = len(order)
                order.append(made)
        at += 1
    size = len(order)
    apply = np.array(order, np.uint8)
    times = np.zeros((size, size), np.uint16)
    for i, first in enumerate(order):
        for j, second in enumerate(order):
            times[i, j] = elements[tuple(second[s] for s in first)]
    starts = np.array([[_step(s, c)[1] for c in range(10)] for s in range(STATES)], bool)
    return np.array([elements[g] for g in generators], np.uint16), times, apply, starts


_GENERATOR, _TIMES, _APPLY, _STARTS = _monoid()
_CLASSES: list[np.ndarray] = []


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point; made once per process."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def scan(functions: np.ndarray, width: int = 512) -> np.ndarray:
    """Inclusive scan of monoid elements: block-wise down the columns, then over the block totals."""
    n = len(functions)
    if n <= width:
        out = np.empty(n, np.uint16)
        acc = 0
        for i, f in enumerate(functions.tolist()):
            acc = int(_TIMES[acc, f])
            out[i] = acc
        return out
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    size = len(_TIMES)
    flat = _TIMES.ravel()
    acc = grid[0].astype(np.intp)
    for row in grid[1:]:
        acc = flat[acc * size + row]
        row[:] = acc
        acc = acc.astype(np.intp)
    before = np.concatenate(([0], scan(grid[-1])[:-1])).astype(np.intp) * size
    for row in grid:
        row[:] = flat[before + row]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def classify(data: np.ndarray) -> np.ndarray:
    """Class of every byte of texts that each end with a 0xFF sentinel byte."""
    table = codepoint_classes()
    low = np.full(256, CONT, np.uint8)
    low[:128] = table[:128]
    low[255] = EDGE
    cls = low[data]
    lead = np.flatnonzero((data >= 0xC0) & (data < 0xF8))
    if len(lead):
        b0 = data[lead].astype(np.int32)
        follow = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 63 for k in (1, 2, 3)]
        point = np.where(
            b0 < 0xE0,
            (b0 & 31) << 6 | follow[0],
            np.where(b0 < 0xF0, (b0 & 15) << 12 | follow[0] << 6 | follow[1], (b0 & 7) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]),
        )
        cls[lead] = table[np.minimum(point, 0x10FFFF)]
    white = np.flatnonzero(cls == SPACE)
    if len(white):
        width = np.ones(len(white), np.intp)
        wide = data[white]
        width[wide >= 0xC0] = 2
        width[wide >= 0xE0] = 3
        after = cls[np.minimum(white + width, len(cls) - 1)]
        ends = (after != SPACE) & (after != EDGE)
        cls[white[ends]] = np.where(data[white[ends]] == 0x20, PREFIX, LAST)
    mark = np.flatnonzero(data == 0x27)
    if len(mark):
        one, two = (data[np.minimum(mark + k, len(data) - 1)] for k in (1, 2))
        cls[mark[np.isin(one, np.frombuffer(b"stmd", np.uint8))]] = SHORT1
        pair = one.astype(np.int32) << 8 | two
        cls[mark[np.isin(pair, [0x7265, 0x7665, 0x6C6C])]] = SHORT2
    return cls


def token_starts(data: np.ndarray) -> np.ndarray:
    """Positions at which slices start, in the bytes of sentinel-ended texts."""
    cls = classify(data)
    states = scan(_GENERATOR[cls])
    before = np.empty(len(cls), np.uint8)
    before[0] = S_EDGE
    before[1:] = _APPLY[states[:-1], S_EDGE]
    return np.flatnonzero(_STARTS[before, cls])


class PairTable:
    """Open-addressing table from a pair of token ids to the id of their merge."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token, space, rank on each line)."""

    def __init__(self, ranks: bytes):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:4]}")
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        size = max(self.tokens) + 1
        self.width = np.zeros(size, np.int32)
        keys, values = [], []
        for token, rank in self.ids.items():
            self.width[rank] = len(token)
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self._merge: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.int32), 0

    def _heap_merge(self, piece: bytes) -> list[int]:
        """One long slice: lowest rank first, leftmost among equals, in n log n."""
        merge = self._merge = self._merge or dict(zip(self.pairs.keys.tolist(), self.pairs.values.tolist(), strict=True))
        token = [int(self.of_byte[b]) for b in piece]
        n = len(token)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := merge.get(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                prior[after[j]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := merge.get(token[a] << 32 | token[b])) is not None:
                    heapq.heappush(queue, (r, a, token[a], token[b]))
        return [t for t in token if t >= 0]

    def _merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all slices in order, number of tokens of each)."""
        none = PairTable.NONE
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), lengths)
        done_token, done_piece = [], []
        rank = np.full(len(token), none, np.int32)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.pairs(token[inner] << 32 | token[inner + 1])
        while len(token):
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(token)))
            active = np.repeat(least < none, sizes)
            if not active.all():
                done_token.append(token[~active])
                done_piece.append(piece[~active])
                token, piece, rank, least, sizes = token[active], piece[active], rank[active], least[least < none], sizes[least < none]
                if not len(token):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            token, piece, rank = token[keep], piece[keep], rank[keep]
            for p in (moved, moved - 1):
                p = p[(p >= 0) & (p < len(token))]
                same = np.zeros(len(p), bool)
                inside = p + 1 < len(token)
                same[inside] = piece[p[inside]] == piece[p[inside] + 1]
                rank[p[~same]] = none
                q = p[same]
                rank[q] = self.pairs(token[q] << 32 | token[q + 1])
        token, piece = np.concatenate(done_token), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return token[order].astype(np.int32), np.bincount(piece, minlength=len(pieces))

    def _learn(self, pieces: list[bytes]) -> None:
        """Put the slices' tokens into the cache."""
        long = [p for p in pieces if len(p) > LONG_SLICE]
        short = [p for p in pieces if len(p) <= LONG_SLICE]
        flat, counts = self._merge_many(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        extra = [np.array([self.ids[p]] if p in self.ids else self._heap_merge(p), np.int32) for p in long]
        # A slice that is a token itself is that token, whatever its merges give.
        whole = [(i, t) for i, p in enumerate(short) if (t := self.ids.get(p)) is not None]
        if whole:
            index = np.array([i for i, _ in whole])
            if (counts[index] != 1).any():
                parts = np.split(flat, np.cumsum(counts)[:-1])
                for i, t in whole:
                    parts[i] = np.array([t], np.int32)
                flat, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        flat = np.concatenate([flat, *extra])
        counts = np.concatenate([counts, [len(x) for x in extra]]).astype(np.int64)
        size, more = len(self.cache), len(counts)
        while size + more > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin] * 2), np.concatenate([self.count] * 2)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.begin[size : size + more] = self.used + np.cumsum(counts) - counts
        self.count[size : size + more] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.cache.update(zip(short + long, range(size, size + more), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts, each token's end in its text, and the texts' bounds in both."""
        n = len(offsets) - 1
        marked = np.full(len(data) + n, 255, np.uint8)
        marked[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        text_start = offsets[:-1] + np.arange(n)
        start = token_starts(marked)
        text = np.searchsorted(text_start, start, "right") - 1
        stop = np.append(start[1:], len(marked))
        stop = np.minimum(stop, text_start[text] + np.diff(offsets)[text])
        if len(self.cache) > CACHE_SLICES:
            self._reset()
        raw = marked.tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        seen = [*map(self.cache.get, pieces)]
        if None in seen:
            self._learn([*dict.fromkeys(p for p, k in zip(pieces, seen, strict=True) if k is None)])
            seen = [*map(self.cache.get, pieces)]
        k = np.array(seen, np.int64)
        counts = self.count[k]
        total = np.cumsum(counts)
        where = np.repeat(self.begin[k] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
        ids = self.pool[where]
        bounds = np.concatenate(([0], total))[np.searchsorted(text, np.arange(n + 1))]
        run = np.cumsum(self.width[ids], dtype=np.int64)
        ends = run - np.repeat(np.concatenate(([0], run))[bounds[:-1]], np.diff(bounds))
        return ids, ends.astype(np.int32), bounds

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; unknown ids raise KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODERS: dict[str, ByteBPE] = {}


def coder(digest: str, ranks: bytes) -> ByteBPE:
    """The process's coder for a vocabulary; its cache outlives tasks, as workers are reused."""
    if digest not in _CODERS:
        _CODERS[digest] = ByteBPE(ranks)
    return _CODERS[digest]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    return hashlib.sha256(ranks).hexdigest(), df.sparkSession.sparkContext.broadcast(ranks)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_decoded: bool = False) -> DataFrame:
    """Add token_ids (array<int>) and token_ends (array<int>, byte end of each token in its text).

    ``with_decoded`` also adds decoded (binary), the ids decoded in the same pass.

    ``path`` is a rank file on the driver; its bytes, at most MAX_VOCABULARY_BYTES, are broadcast.
    ``keep`` limits the columns carried along (default: all). Null and empty texts get empty
    arrays; repeated rows stay repeated; input columns named like the two outputs are replaced.
    Map-only: no shuffle, memory bound by one chunk of text and the slice cache.
    """
    digest, ranks = _vocabulary(df, path)
    source = without(df, "token_ids", "token_ends", *["decoded"] * with_decoded)
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    fields = [source.schema[c] for c in kept]
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("token_ends", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([*fields, *added, *[T.StructField("decoded", T.BinaryType())] * with_decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(digest, ranks.value)
        for batch in batches:
            for part, data, offsets in string_chunks(batch, text, STEP_BYTES):
                ids, ends, bounds = bpe.encode(data, offsets)
                at = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, ends)]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                if with_decoded:
                    lists.append(pa.array([bpe.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded (binary): the bytes of the token ids. Null ids give null, unknown ids an error."""
    digest, ranks = _vocabulary(df, path)
    source = without(df, "decoded")
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, ids])])
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(digest, ranks.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            out = [bpe.decode(flat[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], present, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)
