"""Toxicity: a linear-chain conditional random field over words, aggregated to document scores.

Token labels come from the document labels: a greedy cover picks the words that account for the
toxic documents and hardly occur in clean ones. The field (two tags, a weight for each known word
and word prefix, transitions) is fitted to the tagged sequences. Marginals come from forward-backward, run as an
associative scan of 2 x 2 matrices over all tokens of a chunk, documents resetting the chain.
A document's score calibrates its largest and its summed marginals; its spans are the runs of
tokens that are more likely toxic than not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_chunks, without
from .decontam import Lookup, Words

#: Labelled rows of each kind in the training sample, and the characters that a longer text teaches with:
#: a window at a place that a hash of the key chooses. Together they bound what comes to the driver.
TRAIN_ROWS = 500
TRAIN_CHARS = 8_000
#: A trigger word explains this many otherwise unexplained toxic documents, and is in clean ones
#: at most at this fraction of its rate in toxic ones.
MIN_GAIN, MAX_CLEAN = 5, 0.05
STEPS, RATE, L2 = 80, 0.3, 1e-3
STEP_BYTES = 1 << 20
THRESHOLD = 0.3


#: Bytes of the word prefixes that are features beside the whole word.
PREFIXES = (4, 5, 6, 8)


def features_of(words: Words) -> list[np.ndarray]:
    return [words.hash, *(words.prefix_hash(k) for k in PREFIXES)]


def _scan(m: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix products (up to a factor) of n 2 x 2 matrices, as (n, 4): block-wise, then across blocks."""

    def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b, c, d = x.T
        e, f, g, h = y.T
        out = np.stack((a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h), axis=1)
        return out / out.max(axis=1, keepdims=True)

    n = len(m)
    blocks = -(-n // width) if n > width else 1
    size = width if n > width else n
    grid = np.zeros((blocks * size, 4))
    grid[:, 0] = grid[:, 3] = 1
    grid[:n] = m
    grid = np.ascontiguousarray(grid.reshape(blocks, size, 4).transpose(1, 0, 2))
    for i in range(1, size):
        grid[i] = times(grid[i - 1], grid[i])
    if blocks > 1:
        before = _scan(grid[-1])[:-1]
        for i in range(size):
            grid[i, 1:] = times(before, grid[i, 1:])
    return grid.transpose(1, 0, 2).reshape(-1, 4)[:n]


@dataclass
class Field:
    """The fitted field; features (words and prefixes) are known by their 64-bit hashes."""

    words: np.ndarray
    weights: np.ndarray
    bias: float = -4.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    initial: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 1.0]))

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(features[0]), self.bias)
        find = Lookup(self.words)
        for hashes in features:
            at, place = find(hashes)
            out[at] += self.weights[place]
        return out

    def passes(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Step matrices, forward and backward messages (ratios within a token) of all tokens."""
        top = np.maximum(emission, 0)
        weight = np.stack((np.exp(-top), np.exp(emission - top)), axis=1)
        step = np.exp(self.transitions).ravel()[None, :] * weight[:, [0, 1, 0, 1]]
        start = np.exp(self.initial)[None, :] * weight[first]
        step[first] = start[:, [0, 1, 0, 1]]
        forward = _scan(step)[:, :2]
        # Backward: products of the later steps, from the right; transposed they are prefixes again.
        back = np.ones((len(step), 2))
        if len(step) > 1:
            later = _scan(step[:0:-1][:, [0, 2, 1, 3]])
            back[:-1] = (later[:, [0, 1]] + later[:, [2, 3]])[::-1]
        return step, forward, back

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(emission):
            return np.zeros(0)
        _, forward, back = self.passes(emission, first)
        joint = forward * back
        return joint[:, 1] / joint.sum(axis=1)


def summaries(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: 1, the log-odds of its largest marginal, the log of 1 + its likely tokens' sum."""
    out = np.zeros((len(bounds) - 1, 3))
    out[:, 0], out[:, 1] = 1, -9.0
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        top = np.clip(np.maximum.reduceat(p, bounds[full]), 1.3e-4, 1 - 1.3e-4)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(p > 0.5, p, 0), bounds[full]))
    return out


def _fit(model: Field, places: list[np.ndarray], tags: np.ndarray, first: np.ndarray) -> None:
    """Full-batch Adagrad on the tagged sequences' log-likelihood; a place is -1 for an unknown feature."""
    known = [np.flatnonzero(p >= 0) for p in places]
    places = [p[k] for p, k in zip(places, known, strict=True)]
    inner = np.ones(len(tags), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    pairs = np.bincount(tags[inner - 1] * 2 + tags[inner], minlength=4).reshape(2, 2)
    begin = np.bincount(tags[first], minlength=2)
    heat = [np.full(len(model.weights), 1e-6), np.full(1, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    n = len(tags)
    for _ in range(STEPS):
        emission = np.full(n, model.bias)
        for k, place in zip(known, places, strict=True):
            emission[k] += model.weights[place]
        step, forward, back = model.passes(emission, first)
        joint = forward * back
        p = joint[:, 1] / joint.sum(axis=1)
        xi = forward[inner - 1][:, :, None] * step[inner].reshape(-1, 2, 2) * back[inner][:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        off = tags - p
        slopes = [
            sum(np.bincount(place, off[k], len(model.weights)) for k, place in zip(known, places, strict=True)) / n - L2 * model.weights / n,
            np.array([off.sum() / n]),
            (pairs - xi.sum(axis=0)) / n,
            (begin - np.array([(1 - p[first]).sum(), p[first].sum()])) / n,
        ]
        for h, g in zip(heat, slopes, strict=True):
            h += g * g
        moves = [RATE * 3 * g / np.sqrt(h) for h, g in zip(heat, slopes, strict=True)]
        model.weights += moves[0]
        model.bias += float(moves[1][0]) / 3
        model.transitions += moves[2] / 3
        model.initial += moves[3] / 3


def _triggers(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Word hashes that, one after the other, explain most of the toxic documents left."""
    distinct = [np.unique(d[d > 0]) for d in documents]
    words, back = np.unique(np.concatenate(distinct), return_inverse=True)
    owner = np.repeat(np.arange(len(distinct)), [len(d) for d in distinct])
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    in_toxic = np.bincount(back, toxic[owner], len(words))
    in_clean = np.bincount(back, ~toxic[owner], len(words))
    fit = (in_toxic >= MIN_GAIN) & (in_clean / n_clean <= MAX_CLEAN * in_toxic / n_toxic)
    chosen = []
    left = toxic.copy()
    while left.any():
        gain = np.where(fit, np.bincount(back, left[owner], len(words)) + 1e-3 * in_toxic - in_clean, 0)
        best = int(gain.argmax())
        if gain[best] < MIN_GAIN:
            break
        chosen.append(words[best])
        fit[best] = False
        left[owner[back == best]] = False
    # Words as toxic, and as widespread, as the chosen ones count too.
    if chosen:
        spread = np.median(in_toxic[np.searchsorted(words, np.array(chosen))])
        chosen += words[fit & (in_toxic >= spread / 2)].tolist()
    return np.unique(np.array(chosen, np.uint64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field | None:
    """Fit on at most TRAIN_ROWS toxic and TRAIN_ROWS clean labelled rows of docs; None without both kinds.

    Rows are drawn by a hash of the key; texts over TRAIN_CHARS teach with a window of that length. A
    key labelled twice counts once, as its higher label; of rows that repeat a key one teaches, the
    least by its window; null keys and labels, null and empty texts teach nothing.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("l_key")).agg(F.max(label).alias("l_label"))
    full = docs.filter(F.octet_length(text) > 0)
    eligible = full.select(F.col(key).alias("key"), F.xxhash64(key).alias("h")).distinct()
    kinds = eligible.join(marked, F.col("key") == F.col("l_key")).select("key", "l_label", "h")
    drawn = None
    for kind in (kinds.filter("l_label >= 1"), kinds.filter("l_label = 0")):
        part = kind.orderBy("h", "key").limit(TRAIN_ROWS)
        drawn = part if drawn is None else drawn.union(part)
    # 2 * TRAIN_ROWS rows of 16 bytes at most: always small enough to broadcast.
    picked = drawn.select(F.col("key").alias("d_key"), "l_label").distinct()
    start = F.pmod(F.xxhash64("key", F.lit("window")), F.length("text") - TRAIN_CHARS + 1).cast("int") + 1
    window = F.when(F.length("text") > TRAIN_CHARS, F.substring("text", start, F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    chosen = full.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("key") == F.col("d_key"))
    rows = chosen.select("key", "l_label", window.alias("text"), (F.length("text") > TRAIN_CHARS).alias("cut")).groupBy("key").agg(F.min(F.struct("text", "cut")).alias("t"), F.max("l_label").alias("l_label")).select("key", "t.*", "l_label").collect()
    rows.sort(key=lambda r: (r["key"], r["text"]))
    if len({r["l_label"] >= 1 for r in rows}) < 2:
        return None
    raw = [r["text"].encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    features = features_of(words)
    documents = [np.concatenate([f[a:b] for f in features]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    toxic = np.array([r["l_label"] >= 1 for r in rows])
    triggers = Lookup(_triggers(documents, toxic))
    distinct, counts = np.unique(np.concatenate(features), return_counts=True)
    model = Field(distinct[(counts >= 3) & (distinct > 0)], np.zeros(0))
    model.weights = np.zeros(len(model.words))
    known = Lookup(model.words)
    places = [np.full(len(words.hash), -1) for _ in features]
    tags = np.zeros(len(words.hash), np.int64)
    for f, place in zip(features, places, strict=True):
        at, k = known(f)
        place[at] = k
        tags[triggers(f)[0]] = 1
    tags[~np.repeat(toxic, np.diff(words.bounds))] = 0
    first = words.bounds[:-1][np.diff(words.bounds) > 0]
    _fit(model, places, tags, first)
    heavy = np.abs(model.weights) > 1e-3
    model.words, model.weights = model.words[heavy], model.weights[heavy]
    # A toxic text's window may miss what is toxic in it; without a tag it says nothing about scores.
    tagged = np.concatenate(([0], np.cumsum(tags)))[words.bounds]
    told = ~np.array([r["cut"] for r in rows]) | ~toxic | (np.diff(tagged) > 0)
    seen = summaries(model.marginals(model.emissions(features), first), words.bounds)
    model.calibration = _logistic(seen[told], toxic[told])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def score(docs: DataFrame, model: Field | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and toxic_spans (array of (start, stop, p): code points, largest marginal).

    Null and empty texts get the score of a text without tokens and no spans; without a model
    every score is 0. Repeated rows score alike; clashing columns are replaced. Map-only.
    """
    source = without(docs, "score", "toxic_spans")
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Field | None = shared.value
        for batch in batches:
            for part, data, offsets in string_chunks(batch, text, STEP_BYTES):
                spans: list[list] = [[] for _ in range(part.num_rows)]
                scores = np.zeros(part.num_rows)
                if m is not None:
                    words = Words(data, offsets)
                    first = words.bounds[:-1][np.diff(words.bounds) > 0]
                    p = m.marginals(m.emissions(features_of(words)), first)
                    z = summaries(p, words.bounds) @ m.calibration
                    scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    hot = np.flatnonzero(p > 0.5)
                    if len(hot):
                        point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                        doc = np.searchsorted(words.bounds, hot, "right") - 1
                        cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(doc) > 0)) + 1
                        for run_ in np.split(np.arange(len(hot)), cut):
                            a, b, d = hot[run_[0]], hot[run_[-1]], doc[run_[0]]
                            base = point[offsets[d]]
                            spans[d].append({"start": int(point[words.start[a]] - base), "stop": int(point[words.stop[b]] - base), "p": float(p[a : b + 1].max())})
                given = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*given, pa.array(scores), pa.array(spans, arrow_span)], names=schema.names)

    return source.mapInArrow(run, schema)
