"""SimHash near-duplicates by multi-index hashing.

Two operators share the method. ``components`` links fingerprints: two segments of 32 bits each; of
two fingerprints at distance 3 or less, one segment differs in one bit at most, so every fingerprint
looks up, in each segment's table, the Hamming ball of radius 1 around its own segment, and the
complete distance of what it meets is verified. ``near_components`` finds near-duplicate texts, which
lie much further apart: wider fingerprints, balls over each segment's least certain bits, complete
distances, and at last the exact similarity of the texts. What the fingerprints miss, an exact
prefix-filtered join of the shingle sets adds. Tables hold each distinct fingerprint or set of
shingles once, so copies of a text cost nothing here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, connected_components, string_chunks, without

#: Words in a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer; the two-segment tables are exact up to 3.
DISTANCE = 3
_SEGMENTS = 2
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each shingle, repeats included, and the text it is in); a shorter text is one shingle."""
    raw = data.tobytes()
    n = len(offsets) - 1
    lines = [b" ".join(raw[a:b].lower().split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    flat = b"\n".join(lines) + b"\n"
    codes = np.frombuffer(flat, np.uint8)
    stop = np.flatnonzero((codes == 32) | (codes == 10))
    start = np.concatenate(([0], stop[:-1] + 1))
    ends = codes[stop] == 10
    text = np.cumsum(ends) - ends
    full = stop > start
    start, stop, text = start[full], stop[full], text[full]
    words = np.bincount(text, minlength=n)
    first = np.cumsum(words) - words
    whole = first[(words > 0) & (words < shingle)]
    body = np.flatnonzero(np.arange(len(text)) + shingle - 1 < (first + words)[text])
    begin = np.concatenate((body, whole))
    last = np.concatenate((body + shingle - 1, whole + words[text[whole]] - 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(start[begin].tolist(), stop[last].tolist(), strict=True)), np.uint64, len(begin))
    return hashes, text[begin]


def set_counts(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, 64): of each text, how many of its hashes have each bit."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(owner * 256 + octets[:, k], minlength=n * 256).reshape(n, 256).astype(np.float32) @ _BITS for k in range(8)], axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans as unsigned numbers, the first one lowest."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of texts given as bytes and offsets."""
    n = len(offsets) - 1
    hashes, owner = shingle_hashes(data, offsets, shingle)
    return _packed(set_counts(hashes, owner, n) * 2 > np.bincount(owner, minlength=n)[:, None])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add simhash (long, the 64 bits as a signed number). Null and empty texts get 0."""
    source = without(docs, "simhash")
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in string_chunks(batch, text):
                found = fingerprint_batch(data, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(found)], names=[*kept, "simhash"])

    return source.mapInArrow(run, schema)


def links(prints: DataFrame, fp: str = "simhash", distance: int = DISTANCE) -> DataFrame:
    """(low, high): pairs of distinct fingerprints at ``distance`` bits or fewer.

    ``prints`` has each fingerprint once. Tables and probes meet on (segment, value), 32-bit keys
    that stay sparse for billions of fingerprints; the join is a sort-merge join of two exchanges,
    so a crowded value is split at run time.
    """
    if distance > 2 * _SEGMENTS - 1:
        raise ValueError(f"two segments and balls of radius 1 are exact up to distance {2 * _SEGMENTS - 1}")
    own = prints.select(F.col(fp).alias("fp"))
    segments = [F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)]
    # One key holds the segment's number in bit 32 and its value below.
    keys = F.array(*[s.bitwiseOR(F.lit(k << 32)) for k, s in enumerate(segments)])
    stored = own.select(F.explode(keys).alias("key"), F.col("fp").alias("high"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b) for b in range(32)])
    probes = own.select(F.explode(keys).alias("centre"), F.col("fp").alias("low")).select(F.explode(F.transform(flips, lambda f: F.col("centre").bitwiseXOR(f))).alias("key"), "low")
    near = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= distance
    return probes.hint("merge").join(stored, [probes.key == stored.key, F.col("low") < F.col("high"), near]).select("low", "high").distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash, component_id) for every row of docs; component_id is the smallest key reachable.

    Documents of one fingerprint form a class, named by its smallest key; links join classes;
    classes are contracted to components. Rows with a null key are kept and never name a
    component unless the whole class is null. Repeated rows stay repeated; an empty table gives
    an empty table; texts without words share fingerprint 0 and link like any other.
    """
    prints = checkpointed(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", ["key"]))
    classes = checkpointed(prints.groupBy("simhash").agg(F.min("key").alias("rep")))
    pairs = links(classes)
    low, high = (classes.select(F.col("simhash").alias(n), F.col("rep").alias(f"{n}_rep")) for n in ("low", "high"))
    edges = pairs.join(low, "low").join(high, "high").select(F.col("low_rep").alias("a"), F.col("high_rep").alias("b")).dropna()
    roots = connected_components(edges)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("simhash").alias("fp"), F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named.hint("merge"), F.col("simhash") == F.col("fp")).select(F.col("key").alias(key), "simhash", "component_id")


# Near-duplicates on word shingles: wide fingerprints, balls over the uncertain bits, exact verification.

#: Words in a shingle and Jaccard similarity of the shingle sets from which texts are near-duplicates.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: A wide fingerprint has this many numbers of 64 bits, and twice as many segments of 32 bits.
WIDE = 4
#: The ball around a segment flips any of its so many least certain bits, on both sides of a match.
UNCERTAIN = 5
#: Distance, of the 256 bits, up to which pairs are verified. Sets at similarity 0.8 differ in 39 on
#: average, with a deviation of 6.
WIDE_DISTANCE = 57
#: A shingle that tasks count this often is common and comes late in the order of all shingles, which
#: at most so many do. The order decides how much is compared, never what is found.
COMMON_FROM, COMMON = 32, 1 << 18
#: Shingles that a task counts at a time, and pairs of places that a task looks at in one step.
COUNTED, STEP_PAIRS = 1 << 21, 1 << 22
#: Words of 64 bits in the bitmap of the keys in pairs: most other texts stay where they are.
BITMAP_WORDS = 1 << 18


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashes, texts in order, hashes ascending."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _digests(hashes: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """Digest of each text's set."""
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).tolist()
    return [hashlib.sha256(hashes[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _stretched(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash."""
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_batch(data: np.ndarray, offsets: np.ndarray, shingle: int = NEAR_SHINGLE) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(digest of the shingle set, fingerprint as WIDE numbers, masks of the uncertain bits per segment) of texts."""
    n = len(offsets) - 1
    hashes, owner = _distinct(*shingle_hashes(data, offsets, shingle))
    size = np.bincount(owner, minlength=n)
    digests = _digests(hashes, owner, n)
    prints, masks = np.zeros((n, WIDE), np.uint64), np.zeros((n, 2 * WIDE, UNCERTAIN), np.uint8)
    for k in range(WIDE):
        counts = set_counts(_stretched(hashes, k + 1), owner, n)
        prints[:, k] = _packed(counts * 2 > size[:, None])
        margin = np.abs(counts * 2 - size[:, None]).reshape(n, 2, 32)
        masks[:, 2 * k : 2 * k + 2] = np.argsort(margin, axis=2, kind="stable")[:, :, :UNCERTAIN]
    return digests, prints, masks


def balls(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(texts, segments * 2**UNCERTAIN) table keys: the segment's number above 32 bits of its value, flipped every way."""
    n = len(prints)
    segments = prints.view(np.uint32).reshape(n, 2 * WIDE).astype(np.int64)
    flips = np.zeros((n, 2 * WIDE, 1), np.int64)
    for k in range(UNCERTAIN):
        flips = np.concatenate((flips, flips ^ (np.int64(1) << masks[:, :, k].astype(np.int64))[:, :, None]), axis=2)
    keys = (segments[:, :, None] ^ flips) | (np.arange(2 * WIDE, dtype=np.int64) << 32)[None, :, None]
    return keys.reshape(n, -1)


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a binary column, one after the other, as numbers."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in string_chunks(batch, "text"):
            digests, prints, masks = wide_batch(data, offsets)
            columns = [part.column(0), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([x.tobytes() for x in masks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "print", "uncertain"])


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rep) of every table key of every text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            prints = _fixed(part.column(1), np.uint64).reshape(-1, WIDE)
            masks = _fixed(part.column(2), np.uint8).reshape(-1, 2 * WIDE, UNCERTAIN)
            keys = balls(prints, masks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["bucket", "rep"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those that share its value with a neighbour; the last row waits for the next batch."""
    held, held_shares = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        value = rows.column(0).to_numpy()
        shares = np.zeros(len(value), bool)
        same = value[1:] == value[:-1]
        shares[1:] |= same
        shares[:-1] |= same
        shares[0] |= held_shares
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(shares[:-1]))
        held, held_shares = rows.slice(rows.num_rows - 1), bool(shares[-1])
    if held is not None and held_shares:
        yield held


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Least spanning forest of fingerprints (n, words) under links of ``distance`` bits or fewer, as pairs of places.

    A forest has the components of all the links at every smaller distance, without listing the links.
    """
    n = len(prints)
    out = []
    best, link = np.full(n, 1 << 30), np.full(n, -1)
    open_ = np.ones(n, bool)
    at = 0
    for _ in range(n):
        open_[at] = False
        left = np.flatnonzero(open_)
        if not len(left):
            break
        d = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.int64)
        nearer = d < best[left]
        best[left[nearer]], link[left[nearer]] = d[nearer], at
        at = int(left[best[left].argmin()])
        if best[at] <= distance:
            out.append((int(link[at]), at))
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, in batches that end where its value does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        start = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        if start or held and held[-1].column(0)[0].as_py() != bucket[0]:
            whole = [*held, batch.slice(0, start)] if start else held
            held = []
            yield pa.concat_batches(whole)
        held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    """Pairs of different keys once each, the smaller one first."""
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["low", "high"])


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high): per bucket, the links of its forest; rows come sorted by bucket, then rep.

    Neighbours share many buckets; a group met before in the task is not compared again. A forest
    leaves out links, and one of its own may fail the exact test; ``_prefix_rows`` finds the rest.
    """
    seen: set[bytes] = set()
    for rows in whole_buckets(batches):
        bucket, reps, prints = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _fixed(rows.column(2), np.uint64).reshape(-1, WIDE)
        first = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1))
        size = np.diff(np.append(first, len(bucket)))
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= WIDE_DISTANCE]
        found = [np.stack((reps[two], reps[two + 1]), axis=1)]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            group = reps[a : a + n]
            name = hashlib.sha256(group.tobytes()).digest()
            if name not in seen:
                seen.add(name)
                found.append(group[np.array(forest(prints[a : a + n], WIDE_DISTANCE), np.int64).reshape(-1, 2)])
        yield _links(np.concatenate(found))
        if len(seen) > 1 << 20:
            seen.clear()


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n): shingles that are in two texts or more of those that a task counts at a time."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

    for batch in batches:
        for _, data, offsets in string_chunks(batch, "text"):
            held.append(_distinct(*shingle_hashes(data, offsets, NEAR_SHINGLE))[0])
            if sum(map(len, held)) > COUNTED:
                yield counted()
                held = []
    if held:
        yield counted()


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles, ascending; the rank of each, from 1 for the least common)."""
    counts = texts.select("text").mapInArrow(_count_rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    shingles = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.arange(len(shingles), 0, -1)[order]


def prefixes(hashes: np.ndarray, owner: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, sizes) of the first shingles of n texts' sets, text by text.

    Shingles are ordered by rank, those that are not common first, then by hash. Two sets of sizes a
    and b at the similarity share that share of either one, so the first shared shingle is not among
    the last ones that would be too few, and both prefixes hold it.
    """
    shingles, ranks = common
    rank = np.zeros(len(hashes), np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, hashes), len(shingles) - 1)
        rank = np.where(shingles[at] == hashes, ranks[at], 0)
    order = np.lexsort((hashes, rank, owner))
    hashes, owner = hashes[order], owner[order]
    sizes = np.bincount(owner, minlength=n)
    places = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    held = places <= (sizes - _least(sizes))[owner]
    return hashes[held], places[held], sizes


def _least(sizes: np.ndarray) -> np.ndarray:
    """Shingles that a set of each size shares, at least, with one at the similarity."""
    return np.ceil(NEAR_SIMILARITY * sizes - 1e-6).astype(np.int64)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rep, the set's size above 32 bits of the place) of every shingle of every prefix."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            n = np.array([len(x) // 8 for x in part.column(1).to_pylist()])
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(part.column(2).to_numpy(), n) << 32 | places
            yield pa.RecordBatch.from_arrays([pa.array(_fixed(part.column(1), np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(at)], names=["bucket", "rep", "at"])


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high): per bucket, every pair of different roots that its sizes and places let reach the similarity.

    In the bucket of a pair's first shared shingle, what the two can share is that one and the
    shingles behind it, on the side with fewer; a pair within reach passes there, if not elsewhere.
    """
    for rows in whole_buckets(batches):
        bucket, reps, at, roots = (rows.column(k).to_numpy() for k in range(4))
        sizes, places = at >> 32, at & 0xFFFFFFFF
        first = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1))
        mixed = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
        ends = np.append(first[1:], len(bucket))
        found, waiting = [], 0
        for a, b in zip(first[mixed].tolist(), ends[mixed].tolist(), strict=True):
            step = max(1, STEP_PAIRS // (b - a))
            for low in range(a, b, step):
                i, j = slice(low, min(low + step, b)), slice(low, b)
                reach = np.minimum.outer(sizes[i] - places[i], sizes[j] - places[j])
                near = (reach >= NEAR_SIMILARITY / (1 + NEAR_SIMILARITY) * np.add.outer(sizes[i], sizes[j]) - 1e-6) & np.not_equal.outer(roots[i], roots[j])
                x, y = np.nonzero(near)
                found.append(np.stack((reps[low + x], reps[low + y]), axis=1))
                waiting += len(x)
                if waiting > STEP_PAIRS:
                    yield _links(np.concatenate(found))
                    found, waiting = [], 0
        if found:
            yield _links(np.concatenate(found))


def _set_of(text: str, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(shingle_hashes(raw, np.array([0, len(raw)]), shingle)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high, one, two = (batch.column(k).to_pylist() for k in range(4))
        sets = {t: _set_of(t) for t in {*one, *two}}
        kept = [(a, b) for a, b, x, y in zip(low, high, one, two, strict=True) if similarity(sets[x], sets[y]) >= NEAR_SIMILARITY]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _similar(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b): those of the pairs (low, high) whose whole texts are similar."""
    met = pairs.select(F.explode(F.array("low", "high")).alias("met")).distinct()
    place = F.pmod(F.xxhash64(F.col("key").cast("long")), F.lit(64 * BITMAP_WORDS))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = met.select(F.col("met").alias("key")).select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    placed = named.withColumn("place", place).withColumn("bit", bit)
    likely = placed.join(F.broadcast(bits), (F.shiftright("place", 6) == F.col("word")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0), "left_semi").select("key", "text")
    texts = likely.join(met.hint("merge"), F.col("key") == F.col("met"), "left_semi").distinct()
    one, two = texts.select(F.col("key").alias("one_key"), F.col("text").alias("one")), texts.select(F.col("key").alias("two_key"), F.col("text").alias("two"))
    both = pairs.join(one.hint("merge"), F.col("low") == F.col("one_key")).join(two.hint("merge"), F.col("high") == F.col("two_key"))
    return both.select("low", "high", "one", "two").mapInArrow(_verified, "a long, b long")


def _missed(named: DataFrame, classes: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """(low, high): every pair of classes of different components that may be similar, by an exact prefix filter."""
    common = named.sparkSession.sparkContext.broadcast(common_shingles(named))

    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in string_chunks(batch, "text"):
                n = len(offsets) - 1
                hashes, owner = _distinct(*shingle_hashes(data, offsets, NEAR_SHINGLE))
                digests = _digests(hashes, owner, n)
                held, places, sizes = prefixes(hashes, owner, n, common.value)
                bounds = np.append(np.flatnonzero(places == 0), len(places))
                binaries = np.full(n, b"", object)
                binaries[sizes > 0] = [held[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(binaries, pa.binary())], names=["key", "digest", "size", "prefix"])

    firsts = named.mapInArrow(prefix_rows, "key long, digest binary, size long, prefix binary").filter("size > 0")
    homes = classes.select("rep", F.col("digest").alias("own"))
    entries = firsts.join(homes.hint("merge"), [F.col("key") == F.col("rep"), F.col("digest") == F.col("own")]).select("rep", "prefix", "size").mapInArrow(_bucket_rows, "bucket long, rep long, at long")
    crowded = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(shared_rows, "bucket long, rep long, at long")
    compared = crowded.distinct().join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").select("bucket", "rep", "at", F.coalesce("root", "rep").alias("root"))
    return compared.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_prefix_rows, "low long, high long").distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) for every row of docs: near-duplicates by five-word shingles at similarity 0.8.

    Texts with one set of shingles are a class, named by its smallest key. A class's fingerprint has
    256 bits in eight segments; each segment enters its table under a small Hamming ball around it,
    every combination of its five least certain bits. What shares a table entry is compared by the
    complete distance, inside the entry, which emits a spanning forest instead of all pairs; every
    link of a forest is verified by the exact similarity of the whole texts, and links join classes.
    Pairs that this leaves apart are searched exactly: classes of different components that share a
    shingle of their prefixes, and whose sizes and places let them reach the similarity, are verified
    like the others, every pair. So the components are those of all pairs at the similarity. They are
    named by the smallest key reachable. Keys are longs. Rows that repeat a key are one
    document; a null key stays alone; null texts count as empty, and texts without words are copies
    of each other; an empty table gives an empty table; other columns are not read. An entry's
    distinct texts stand in one task with 48 bytes each, and so do those that share a shingle.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.filter("key is not null")
    prints = checkpointed(named.mapInArrow(_set_rows, "key long, digest binary, print binary, uncertain binary"))
    classes = checkpointed(prints.groupBy("digest").agg(F.min("key").alias("rep"), F.min("print").alias("print"), F.min("uncertain").alias("uncertain")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = classes.select("rep", "print", "uncertain").mapInArrow(_table_rows, "bucket long, rep long")
    crowded = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(shared_rows, "bucket long, rep long")
    own = classes.select(F.col("rep").alias("own"), "print")
    compared = crowded.join(own.hint("merge"), F.col("rep") == F.col("own")).select("bucket", "rep", "print")
    pairs = checkpointed(compared.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_forest_rows, "low long, high long").distinct())
    edges = checkpointed(_similar(pairs, named))
    missed = checkpointed(_missed(named, classes, connected_components(edges), parts))
    roots = connected_components(edges.unionByName(_similar(missed, named)))
    homes = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("home"), F.coalesce("root", "rep").alias("component_id"))
    found = prints.join(homes.hint("merge"), F.col("digest") == F.col("home")).select(F.col("key").alias(key), "component_id")
    return found.unionByName(rows.filter("key is null").select(F.col("key").cast("long").alias(key), F.lit(None).cast("long").alias("component_id")))


def near_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when of each near-duplicate component only the document that names it does.

    Rows that repeat a key are one document and stay or go together; rows with a null key stay;
    columns are as they were, whatever their names.
    """
    return _kept(docs, near_components(docs.select(key, text).filter(F.col(key).isNotNull()), key, text), key)


def _kept(docs: DataFrame, components_: DataFrame, key: str) -> DataFrame:
    stays = components_.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("stays")).distinct()
    named = docs.join(stays, docs[key] == stays["stays"], "left_semi")
    return named.unionByName(docs.filter(F.col(key).isNull())) if docs.schema[key].nullable else named


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component, the document whose key names it.

    Rows that repeat a key are one document and stay or go together; rows with a null key can
    not be named and stay.
    """
    return _kept(docs, components(docs.filter(F.col(key).isNotNull()), key, text), key)
