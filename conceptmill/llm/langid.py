"""Language identification by interpolated Kneser-Ney character models.

Text is a sequence of symbols: a space for each run of non-letters, a letter of a to z, or one of
37 classes of other letters, in lower case. A model holds, for orders 4 to 1, the sorted array of
packed n-grams with their counts (continuation counts below the top) and the sorted array of
contexts. A text gets the language of the lowest cross-entropy per symbol; a text whose best
cross-entropy is beyond what that language's own texts show is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, codepoint_classes
from .common import string_chunks, without

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
STEP_BYTES = 1 << 20
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_NGRAMS = 1 << 21
#: Temperatures among which the calibration chooses.
TEMPERATURES = [0.5 * 2**k for k in range(9)]
#: A text is rejected this many standard deviations beyond its language's mean cross-entropy.
REJECT_AT = 6.0
UNDETERMINED = "und"

_SYMBOL: list[np.ndarray] = []
_PLACE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for non-letters."""
    if not _SYMBOL:
        table = np.zeros(0x110000, np.uint8)
        for c in np.flatnonzero(codepoint_classes() == LETTER).tolist():
            low = ord(unicodedata.normalize("NFC", chr(c).lower())[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _SYMBOL.append(table)
    return _SYMBOL[0]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-grams of all texts in order, number of them in each text); none for texts without a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = lead[offsets]
    symbols = symbol_table()[points]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    letter = symbols > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    keep[first] = letter[first]
    symbols, text = symbols[keep], text[keep]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(counts), np.uint32)
    at = np.arange(len(symbols)) + (ORDER - 1) * (text + 1)
    padded[at] = symbols
    codes = padded[at]
    for k in range(1, ORDER):
        codes = codes | padded[at - k] << np.uint32(BITS * k)
    return codes, counts


class KneserNey:
    """One language's interpolated model over packed n-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, 0, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            context, first = np.unique(grams >> BITS, return_index=True)
            total = np.add.reduceat(counts, first).astype(np.float64)
            kinds = np.diff(np.append(first, len(grams)))
            self.levels.append((grams, (counts - discount).clip(0), context, total, discount * kinds / total))
            grams, counts = np.unique(grams & np.uint32((1 << BITS * (order - 1)) - 1), return_counts=True)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the last symbol's probability after the other three, for sorted distinct codes."""
        p = np.full(len(codes), 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            grams, mass, context, total, backoff = self.levels[ORDER - order]
            own = codes & np.uint32((1 << BITS * order) - 1)
            g = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            c = np.minimum(np.searchsorted(context, own >> BITS), len(context) - 1)
            known = context[c] == own >> BITS
            direct = np.where(grams[g] == own, mass[g], 0) / total[c]
            p = np.where(known, direct + backoff[c] * p, p)
        return np.log2(p)


class Model:
    """The languages' models, and what calibrates them."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.temperature = 1.0
        self.limits = np.full(len(languages), np.inf)

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol of each text under each language, symbols of each text)."""
        codes, counts = ngrams(data, offsets)
        out = np.zeros((len(counts), len(self.languages)))
        if len(codes) and self.languages:
            if not _PLACE:
                _PLACE.append(np.zeros(1 << BITS * ORDER, np.int32))
            distinct = np.unique(codes)
            _PLACE[0][distinct] = np.arange(len(distinct))
            scores = np.stack([m.log_probability(distinct) for m in self.models], axis=1).astype(np.float32)[_PLACE[0][codes]]
            full = np.flatnonzero(counts)
            sums = np.add.reduceat(scores, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
            out[full] = -sums / counts[full, None]
        return out, counts


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count 4-grams over all rows with a language and fit the models and their calibration.

    Counts are summed in the tasks before they are shuffled; what reaches the driver is each
    language's distinct packed 4-grams, at most 2**24 however large the input is.
    """
    docs = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                distinct, back = np.unique(codes, return_inverse=True)
                total = np.bincount(back, n, len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct), pa.string()), pa.array(distinct.astype(np.int32)), pa.array(total)], names=["lang", "gram", "n"])

        for batch in batches:
            for part, data, offsets in string_chunks(batch, "text", STEP_BYTES):
                codes, counts = ngrams(data, offsets)
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names.tolist()):
                    own = codes[np.repeat(names == name, counts)]
                    if len(own):
                        held.setdefault(name, []).append(np.unique(own, return_counts=True))
                        size += len(held[name][-1][0])
                if size > HELD_NGRAMS:
                    yield from merged()
                    held, size = {}, 0
        yield from merged()

    total = docs.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frame = total.toPandas().sort_values(["lang", "gram"])
    names, models = [], []
    for name, rows in frame.groupby("lang"):
        names.append(name)
        models.append(KneserNey(rows["gram"].to_numpy(np.uint32), rows["n"].to_numpy(np.int64)))
    model = Model(names, models)
    if names:
        _calibrate(model, docs)
    return model


def _calibrate(model: Model, docs: DataFrame) -> None:
    """Temperature and limits from every training text with a letter; copies in one language count once.

    Texts are told apart by two 64-bit hashes. A row sends its own cross-entropy and its loss at each
    temperature; the driver gets a row per language.
    """
    hashed = docs.select("text", "lang", F.xxhash64("text").alias("g"), F.xxhash64(F.lit(1), "text").alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    losses = [f"loss{k}" for k in range(len(TEMPERATURES))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        places = {name: k for k, name in enumerate(m.languages)}
        for batch in batches:
            for part, data, offsets in string_chunks(batch, "text", STEP_BYTES):
                bits, n = m.cross_entropies(data, offsets)
                full = np.flatnonzero(n)
                bits, part = bits[full], part.take(pa.array(full))
                own = np.array([places[name] for name in part.column(1).to_pylist()], np.int64)
                mine = bits[np.arange(len(own)), own]
                above = bits - bits.min(axis=1, keepdims=True)
                loss = [t * above[np.arange(len(own)), own] + np.log(np.exp(-t * above).sum(axis=1)) for t in TEMPERATURES]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(own), pa.array(mine), *map(pa.array, loss)], names=["g", "h", "own", "bits", *losses])

    scored = hashed.mapInArrow(score, "g long, h long, own long, bits double, " + ", ".join(f"{c} double" for c in losses))
    once = scored.groupBy("g", "h", "own").agg(*[F.min(c).alias(c) for c in ("bits", *losses)])
    rows = once.groupBy("own").agg(F.count("*").alias("n"), F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("std"), *[F.sum(c).alias(c) for c in losses]).collect()
    for r in rows:
        if r["n"] > 1:
            # Rounded, as the order of a sum is not fixed.
            model.limits[r["own"]] = round(r["mean"] + REJECT_AT * max(r["std"], 0.02), 9)
    if rows:
        total = [round(sum(r[c] for r in rows) / sum(r["n"] for r in rows), 9) for c in losses]
        model.temperature = TEMPERATURES[int(np.argmin(total))]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1, the calibrated posterior) and rejected (boolean).

    Null texts and texts without a letter get ``und``, score 0 and rejected; so does every text
    under a model without languages. Ties go to the first language in order. Map-only.
    """
    source = without(docs, "lang_pred", "score", "rejected")
    kept = [c for c in source.columns if keep is None or c in keep]
    source = source.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            for part, data, offsets in string_chunks(batch, text, STEP_BYTES):
                bits, n = m.cross_entropies(data, offsets)
                if m.languages:
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(len(best)), best]
                    score = 1 / np.exp(-m.temperature * (bits - low[:, None])).sum(axis=1)
                    rejected = (n == 0) | (low > m.limits[best])
                    best = np.where(n == 0, len(m.languages), best)
                else:
                    best, score, rejected = np.zeros(len(n), np.int64), np.zeros(len(n)), np.ones(len(n), bool)
                score = np.where(n == 0, 0.0, score)
                given = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*given, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return source.mapInArrow(run, schema)
