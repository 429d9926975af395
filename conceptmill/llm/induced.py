"""Suffix order and common prefixes of records by external induced sorting, piece by piece.

Suffixes are of type S or L as in the classic algorithm. The leftmost S suffixes are ordered first:
one induction sorts their substrings, these get names, and the string of names is ordered by
doubling, as far as the wanted prefix reaches. A second induction carries the order, and with it
the common-prefix values, to all L and then all S suffixes. Suffix tuples wait in a monotone
priority queue keyed by their first symbol, a queue of batches per symbol. What leaves the queue
together, up to a piece, is induced together, so a step is a handful of array operations.

Text, types, names, ranks, orders and waiting tuples live in memory up to a bound in bytes and
beyond it in scratch files of the task, where Spark spills its own data; they are read and written
in pieces, so a block may be far larger than the bound. Scratch files are unlinked when they are
made: a lost task leaves none, and its attempt starts anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that one sort keeps in memory; arrays and waiting tuples beyond them go to scratch files.
MEMORY_BYTES = 512 << 20
#: Entries that one step works on.
PIECE = 1 << 21
_SYMBOLS = 257


class Scratch:
    """What one sort may hold: arrays in memory as long as the bound lasts, then in files."""

    def __init__(self, memory: int = MEMORY_BYTES):
        self.left, self.spilled = memory, 0

    def file(self):
        folders = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or ""
        return tempfile.TemporaryFile(dir=next((f for f in folders.split(",") if os.path.isdir(f)), None))

    def array(self, n: int, kind: type) -> np.ndarray:
        """Zeros."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, kind)
        self.spilled += size
        file = self.file()
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=(n,))

    def drop(self, array: np.ndarray) -> None:
        """The array is not needed any more."""
        if not isinstance(array, np.memmap):
            self.left += array.nbytes


def pieces(n: int) -> Iterator[slice]:
    for low in range(0, n, PIECE):
        yield slice(low, min(low + PIECE, n))


def ordering(keys: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Stable order of numbers: in one go up to a piece, else dealt by value into buckets that are sorted one by one."""
    n = len(keys)
    out = scratch.array(n, np.int64)
    if n <= PIECE:
        out[:] = np.argsort(keys, kind="stable")
        return out
    sample = np.sort(keys[:: max(1, n // 65536)])
    bounds = np.unique(sample[:: max(1, len(sample) * PIECE // (4 * n))])
    counts = np.zeros(2 * len(bounds) + 1, np.int64)
    # A bucket per bound's own value and per gap between bounds, so that a frequent value needs no sort.
    place = lambda x: np.searchsorted(bounds, x, "left") + np.searchsorted(bounds, x, "right")
    for s in pieces(n):
        counts += np.bincount(place(keys[s]), minlength=len(counts))
    first = np.concatenate(([0], np.cumsum(counts)))
    at = first[:-1].copy()
    for s in pieces(n):
        bucket = place(keys[s])
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        begin = np.searchsorted(bucket, bucket)
        out[at[bucket] + np.arange(len(bucket)) - begin] = order + s.start
        at += np.bincount(bucket, minlength=len(counts))
    for k in range(0, len(counts), 2):
        if counts[k] > 1:
            index = np.array(out[first[k] : first[k + 1]])
            out[first[k] : first[k + 1]] = index[np.argsort(keys[index], kind="stable")]
    return out


class BucketQueue:
    """Batches of (position, common prefix with the one before) under their first symbol, first in, first out."""

    def __init__(self, scratch: Scratch):
        self.batches: list[list] = [[] for _ in range(_SYMBOLS)]
        self.scratch, self.store = scratch, None

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        size = positions.nbytes + common.nbytes
        if size > self.scratch.left:
            if self.store is None:
                self.store = self.scratch.file()
            at = self.store.seek(0, 2)
            positions.tofile(self.store)
            common.tofile(self.store)
            self.scratch.spilled += size
            self.batches[symbol].append((at, len(positions), positions.dtype))
        else:
            self.scratch.left -= size
            self.batches[symbol].append((positions, common))

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What waits for a symbol, as one batch, up to a piece."""
        waiting, size = self.batches[symbol], 0
        if not waiting:
            return None
        taken = []
        for b in waiting:
            if taken and size >= PIECE:
                break
            if len(b) == 3:
                self.store.seek(b[0])
                b = np.fromfile(self.store, b[2], b[1]), np.fromfile(self.store, np.uint8, b[1])
            else:
                self.scratch.left += b[0].nbytes + b[1].nbytes
            taken.append(b)
            size += len(b[0])
        del waiting[: len(taken)]
        return taken[0] if len(taken) == 1 else tuple(np.concatenate(x) for x in zip(*taken, strict=True))


class _RangeMin:
    """Least value of ranges of an array, by a table of doubling spans."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, span = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-span], last[span:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Inclusive ranges, none of them empty."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.uint8)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


class Sorter:
    """Order of the suffixes of separator-ended records by their first ``limit`` symbols."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, limit: int = 100, scratch: Scratch | None = None):
        records = len(offsets) - 1
        self.n, self.limit, self.scratch = len(data) + records, limit, scratch or Scratch()
        self.text = t = self.scratch.array(self.n, np.int16)
        low = 0
        while low < records:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
            owner = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
            a, b = int(offsets[low]), int(offsets[high])
            t[np.arange(a, b) + owner] = data[a:b].astype(np.int16) + 1
            low = high
        self.small = self.scratch.array(self.n, bool)
        self.packed = self.scratch.array(self.n + 9, np.uint64)
        found = []
        small_after = True
        for s in reversed([*pieces(self.n)]):
            here = np.zeros(s.stop - s.start + 16, np.int16)
            ahead = t[s.start : s.stop + 16]
            here[: len(ahead)] = ahead
            size = s.stop - s.start
            rises = np.sign(here[1 : size + 1] - here[:size]).astype(np.int8)
            if s.stop == self.n:
                rises[-1] = 1
            # An equal neighbour takes its type from the next change; separators are always S.
            turn = np.where(rises != 0, np.arange(size), size)
            kind = np.append(rises > 0, small_after)[np.minimum.accumulate(turn[::-1])[::-1]]
            kind[here[:size] == 0] = True
            small_after = bool(kind[0])
            self.small[s] = kind
            # Seven symbols of nine bits in one number, so that equal numbers are equal symbols.
            wide = here.astype(np.uint64)
            for k in range(7):
                self.packed[s] |= wide[k : k + size] << np.uint64(9 * (6 - k))
        for s in pieces(self.n):
            lms = np.array(self.small[s])
            before = self.small[s.start - 1 : s.stop - 1] if s.start else np.concatenate(([True], self.small[: s.stop - 1]))
            found.append(np.flatnonzero(lms & ~before) + s.start)
        m = sum(map(len, found))
        self.lms = self.scratch.array(m, np.int64)
        at = 0
        for x in found:
            self.lms[at : at + len(x)] = x
            at += len(x)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffix pairs, up to the limit; separators match nothing."""
        out = np.zeros(len(a), np.uint8)
        live = np.arange(len(a))
        step = 0
        while len(live) and step < self.limit:
            x = np.minimum(a[live] + step, self.n)
            y = np.minimum(b[live] + step, self.n)
            p, q = self.packed[x], self.packed[y]
            same = np.zeros(len(live), np.uint8)
            going = np.ones(len(live), bool)
            for k in range(7):
                shift = np.uint64(9 * (6 - k))
                u, v = (p >> shift) & np.uint64(511), (q >> shift) & np.uint64(511)
                going &= (u == v) & (u > 0)
                same += going
            out[live] = np.minimum(step + same, self.limit)
            live = live[same == 7]
            step += 7
        return out

    def _induce(self, seeds: np.ndarray, seed_common: np.ndarray, large: bool, starts: list, carry: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One direction: L from the leftmost S upward, or S from the L downward.

        ``starts`` has the seeds' bounds per symbol. Returns the induced suffixes in the order of the
        scan, the common prefix of each with the one scanned before it, and the bounds per symbol.
        """
        queue, total = BucketQueue(self.scratch), 0
        size = sum(int((self.small[s] != large).sum()) for s in pieces(self.n))
        made, made_common = self.scratch.array(size, np.int64), self.scratch.array(size, np.uint8)
        bounds = np.zeros((_SYMBOLS, 2), np.int64)
        since = np.zeros(_SYMBOLS, np.uint8)  # least common prefix since the last insertion
        fresh = np.ones(_SYMBOLS, bool)
        last = -1
        for c in range(_SYMBOLS) if large else range(_SYMBOLS - 1, -1, -1):
            bounds[c] = total
            parts = self._parts(queue, c, seeds, seed_common, starts, large)
            for seeding, positions, common in parts:
                if not seeding:
                    made[total : total + len(positions)] = positions
                    made_common[total : total + len(positions)] = common
                    total += len(positions)
                if carry:
                    common = np.array(common)
                    edge = np.array([last]), positions[:1]
                    common[0] = self.common(*edge)[0] if last >= 0 else 0
                    last = int(positions[-1])
                self._step(positions, common, large, queue, since, fresh, carry)
            bounds[c, 1] = total
        return made[:total], made_common[:total], bounds

    @staticmethod
    def _parts(queue: BucketQueue, c: int, seeds: np.ndarray, seed_common: np.ndarray, starts: list, large: bool) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """What a symbol has: the queue until it is empty, also of what a step adds, then the seeds in pieces."""
        while (batch := queue.pop(c)) is not None:
            if len(batch[0]):
                yield False, *batch
        a, b = starts[c], starts[c + 1]
        for s in pieces(b - a):
            part = slice(a + s.start, a + s.stop) if large else slice(b - s.stop, b - s.start)
            step = 1 if large else -1
            yield True, np.array(seeds[part])[::step], np.array(seed_common[part])[::step]

    def _step(self, positions, common, large, queue, since, fresh, carry) -> None:
        before = positions - 1
        index = np.flatnonzero((before >= 0) & (self.small[before] != large))
        # A separator is nobody's S neighbour: records end there.
        before = before[index]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        index, before, symbol = index[order], before[order], symbol[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1]))) if len(symbol) else np.zeros(0, np.int64)
        values = np.zeros(len(before), np.uint8)
        if carry:
            least = _RangeMin(common)
            if len(before):
                prior = np.empty(len(index), np.int64)
                prior[1:] = index[:-1]
                prior[cut] = -1
                values = least(prior + 1, index)
                head = symbol[cut]
                values[cut] = np.where(fresh[head], 0, np.minimum(values[cut], since[head]))
                first_ever = cut[fresh[head]]
                values = np.minimum(values + np.uint8(1), self.limit).astype(np.uint8)
                values[first_ever] = 0
            everything = int(common.min())
            np.minimum(since, everything, out=since)
            if len(before):
                tail = index[np.append(cut[1:], len(index)) - 1]
                open_ = tail + 1 < len(common)
                rest = np.full(len(cut), 255, np.uint8)
                rest[open_] = least((tail + 1)[open_], np.full(int(open_.sum()), len(common) - 1))
                since[symbol[cut]] = rest
                fresh[symbol[cut]] = False
        if not len(before):
            return
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(before)).tolist(), strict=True):
            queue.push(int(symbol[a]), before[a:b], values[a:b])

    def _both(self, ordered: np.ndarray, common: np.ndarray, carry: bool) -> tuple[tuple, tuple]:
        text = lambda x: np.searchsorted(_Gathered(self.text, x), np.arange(_SYMBOLS + 1)).tolist() if len(x) else [0] * (_SYMBOLS + 1)
        large = self._induce(ordered, common, True, text(ordered), carry)
        flat, up, bounds = large
        flat_common = self.scratch.array(len(flat), np.uint8)
        if carry and len(flat):
            # Scanned downward, each is compared with its upper neighbour.
            for s in pieces(len(flat) - 1):
                flat_common[s] = up[s.start + 1 : s.stop + 1]
        starts = [*bounds[:, 0].tolist(), len(flat)]
        small = self._induce(flat, flat_common, False, starts, carry)
        self.scratch.drop(flat_common)
        return large, small

    def _ordered_lms(self) -> np.ndarray:
        """Leftmost S suffixes in the order of their first ``limit`` symbols; ties by position."""
        lms, m, hold = self.lms, len(self.lms), self.scratch
        symbols = hold.array(m, np.int16)
        for s in pieces(m):
            symbols[s] = self.text[lms[s]]
        order = ordering(symbols, hold)
        rough, none = hold.array(m, np.int64), hold.array(m, np.uint8)
        for s in pieces(m):
            rough[s] = lms[order[s]]
        large, small = self._both(rough, none, False)
        is_lms = hold.array(self.n, bool)
        for s in pieces(m):
            is_lms[lms[s]] = True
        # Separators start no induction from below; they come first, in order.
        induced, at = rough, 0
        for s in pieces(m):
            part = lms[s][self.text[lms[s]] == 0]
            induced[at : at + len(part)] = part
            at += len(part)
        positions, _, bounds = small
        for c in range(1, _SYMBOLS):
            for s in pieces(int(bounds[c, 1] - bounds[c, 0])):
                part = positions[bounds[c, 1] - s.stop : bounds[c, 1] - s.start][::-1]
                part = part[is_lms[part]]
                induced[at : at + len(part)] = part
                at += len(part)
        length = hold.array(self.n, np.int64)
        for s in pieces(m):
            stop = np.append(lms[s.start + 1 : s.stop + 1], self.n - 1)[: s.stop - s.start]
            length[lms[s]] = stop - lms[s] + 1
        rank, name = hold.array(self.n, np.int64), 0
        for s in pieces(m):
            b = np.array(induced[s])
            a = np.append(induced[s.start - 1] if s.start else -1, b[:-1])
            new = ~self._same(a, b, length)
            new[0] &= s.start > 0
            names = name + np.cumsum(new)
            rank[b] = names
            name = int(names[-1])
        ranks = hold.array(m, np.int64)
        for s in pieces(m):
            ranks[s] = rank[lms[s]]
        for x in (symbols, order, none, is_lms, length, rank, *large[:2], *small[:2]):
            hold.drop(x)
        reach, distinct = 1, name + 1
        while m and distinct < m and reach < self.limit:
            key = hold.array(m, np.int64)
            for s in pieces(m):
                after = np.zeros(s.stop - s.start, np.int64)
                ahead = ranks[s.start + reach : s.stop + reach]
                after[: len(ahead)] = ahead + 1
                key[s] = ranks[s] * (m + 1) + after
            order, name, last = ordering(key, hold), 0, None
            for s in pieces(m):
                own = key[order[s]]
                new = np.append(last is not None and own[0] != last, own[1:] != own[:-1])
                names = name + np.cumsum(new)
                ranks[order[s]] = names
                name, last = int(names[-1]), own[-1]
            distinct = name + 1
            reach *= 2
            hold.drop(key)
            hold.drop(order)
        order = ordering(ranks, hold)
        for s in pieces(m):
            rough[s] = lms[order[s]]
        hold.drop(ranks)
        hold.drop(order)
        return rough

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the leftmost S substrings at a and b equal? -1 has none; separators equal nothing."""
        same = (a >= 0) & (length[a] == length[b]) & (self.text[a] > 0)
        pair = np.flatnonzero(same)
        span = length[a[pair]]
        for k in range(int(span.max()) if len(span) else 0):
            keep = span > k
            pair, span = pair[keep], span[keep]
            ok = self.text[a[pair] + k] == self.text[b[pair] + k]
            same[pair[~ok]] = False
            pair, span = pair[ok], span[ok]
        return same

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (suffix starts in order, common prefix of each with the one before), separators left out."""
        if not self.n:
            return
        ordered = self._ordered_lms()
        common = self.scratch.array(len(ordered), np.uint8)
        for s in pieces(len(ordered) - 1):
            common[s.start + 1 : s.stop + 1] = self.common(np.array(ordered[s]), np.array(ordered[s.start + 1 : s.stop + 1]))
        (up, up_common, above), (down, down_common, below) = self._both(ordered, common, True)
        for c in range(1, _SYMBOLS):
            top = None
            for s in pieces(int(above[c, 1] - above[c, 0])):
                part = slice(above[c, 0] + s.start, above[c, 0] + s.stop)
                shared = np.array(up_common[part])
                if not s.start:
                    shared[0] = 0
                top = np.array(up[part][-1:])
                yield np.array(up[part]), shared
            # Scanned downward: an entry has the common prefix with the one above it.
            for s in pieces(int(below[c, 1] - below[c, 0])):
                part = slice(below[c, 1] - s.stop, below[c, 1] - s.start)
                starts = np.array(down[part])[::-1]
                shared = np.zeros(len(starts), np.uint8)
                shared[1:] = np.array(down_common[part])[::-1][:-1]
                if s.start:
                    shared[0] = down_common[below[c, 1] - s.start]
                elif top is not None:
                    shared[0] = self.common(top, starts[:1])[0]
                yield starts, shared


class _Gathered:
    """text[positions] as a sequence for binary search, without gathering it."""

    def __init__(self, text: np.ndarray, positions: np.ndarray):
        self.text, self.positions = text, positions

    def __len__(self) -> int:
        return len(self.positions)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.empty(len(self), np.int16)
        for s in pieces(len(self)):
            out[s] = self.text[self.positions[s]]
        return out


def repeated(data: np.ndarray, offsets: np.ndarray, length: int = 100, scratch: Scratch | None = None) -> np.ndarray:
    """For every byte: does the string of ``length`` bytes from here also start at an earlier byte?

    Strings do not cross records. The first start of each class of equal strings is the earliest.
    """
    scratch = scratch or Scratch()
    again = scratch.array(len(data), bool)
    if len(data) < length:
        return again
    # A place in the sorter's text sits one further for each record before.
    begins = offsets[:-1] + np.arange(len(offsets) - 1)

    def mark(places: np.ndarray) -> None:
        again[places - (np.searchsorted(begins, places, "right") - 1)] = True

    least = -1  # of the class that is open: the earliest start so far
    for starts, common in Sorter(data, offsets, length, scratch).order():
        cut = np.flatnonzero(common < length)
        first = np.concatenate(([0], cut)) if not len(cut) or cut[0] else cut
        lows = np.minimum.reduceat(starts, first)
        mark(starts[starts != np.repeat(lows, np.diff(np.append(first, len(starts))))])
        if first[0] not in cut:  # the first class goes on from the piece before
            mark(np.array([max(least, lows[0])]))
            lows[0] = min(least, lows[0])
        least = int(lows[-1])
    return again
