"""Secret scans in SQL expressions: fixed patterns, and windows of high entropy.

Candidate strings are runs of encoded-looking characters. For each, a window of fixed width slides
over the string; the counts of the characters in it are updated by the one that enters and the one
that leaves, and with them the entropy. A candidate whose best window reaches the threshold of its
character class is a span, unless an allow-list pattern suppresses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, without

# Kinds in their order, with pattern, the group that is measured and its least length.
BASE = [
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
ENTROPY = "entropy"
#: A candidate has a digit and this many characters; it starts where a run starts.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = 20
#: Bits per character that the best window must reach, by class; the first class that fits counts.
CLASSES = [("^[0-9a-fA-F]+$", 3.0), ("^[A-Z0-9]+$", 3.4), ("^[A-Za-z0-9]+$", 3.7), ("", 3.8)]
#: Allow-list: candidates that match are never entropy spans.
ALLOWED = "(?i)example|sample|dummy|placeholder|lorem|x{4}|0{6}|1234567|abcdefg|^[0-9+=/_-]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,stop:int,kind:int,rank:int>>"


def _found(body: Column, pattern: str, keep, kind: int) -> Column:
    """Spans of the pattern's matches that ``keep`` admits: the pieces between matches give the offsets."""

    def spans(matches: Column) -> Column:
        pieces = F.slice(F.split(body, pattern, -1), F.lit(1), F.size(matches))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["piece"])
            end = begin + F.length(pair["match"])
            span = F.struct(begin.alias("start"), end.alias("stop"), F.lit(kind).alias("kind"), F.lit(0).alias("rank"))
            return F.struct(end.alias("at"), F.when(keep(pair["match"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).cast(_SPAN).alias("out"))

        pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(spans(m)))


def best_entropy(candidate: Column, width: int = WIDTH) -> Column:
    """Highest Shannon entropy (bits a character) of the candidate's windows, by incremental counts."""
    cost = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def slide(codes: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(F.slice(codes, 1, width), lambda x: x == k)))
        first = let(counts, lambda c: F.struct(c.alias("counts"), *[F.aggregate(c, F.lit(0.0), lambda s, n: s + cost(n)).alias(x) for x in ("sum", "least")]))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - width)
            more, less = F.get(acc["counts"], enters - 1), F.get(acc["counts"], leaves - 1)
            total = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + cost(more + 1) - cost(more) + cost(less - 1) - cost(less))
            now = F.transform(acc["counts"], lambda n, k: n + (k == enters - 1).cast("int") - (k == leaves - 1).cast("int"))
            return F.struct(now.alias("counts"), total.alias("sum"), F.least(acc["least"], total).alias("least"))

        later = F.when(F.size(codes) > width, F.sequence(F.lit(width), F.size(codes) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(later, first, step, lambda acc: F.round(F.log2(F.lit(float(width))) - acc["least"] / width, 6))

    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda codes: let(F.filter(codes, lambda x: x > 0), slide))


def _suspicious(candidate: Column) -> Column:
    threshold = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        threshold = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(threshold)
    return ~candidate.rlike(ALLOWED) & (best_entropy(candidate) >= threshold)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add secret_spans: array of (start, stop, kind, rank), by start, then kind; offsets in code points.

    kind numbers assign, access, hex and entropy from 0. Base kinds are leftmost non-overlapping
    matches each; an entropy span never overlaps a base span. Null and empty texts have no spans;
    repeated rows are scanned alike; a column named secret_spans is replaced. Map-only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = without(docs, "secret_spans", "_base")
    long_enough = lambda pattern, group, least: lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m) >= least
    base = F.concat(*[_found(body, pattern, long_enough(pattern, group, least), k) for k, (_, pattern, group, least) in enumerate(BASE)])
    odd = _found(body, CANDIDATE, _suspicious, len(BASE))

    def joined(base_spans: Column) -> Column:
        free = F.filter(odd, lambda e: ~F.exists(base_spans, lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))
        ordered = lambda a: F.array_sort(a, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"]))
        return ordered(F.concat(base_spans, free))

    return out.withColumn("secret_spans", let(base, joined))


KINDS = [*(name for name, *_ in BASE), ENTROPY]


def rendered(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by MASK; null texts stay null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] >= acc["at"]) & (s["stop"] > acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(masked)
