"""Quality rules: statistics in SQL expressions, and decision lists learned by sequential covering.

A rule is a conjunction of thresholds on a document's statistics that says "reject". Rules are
grown on two thirds of the labelled rows, one condition at a time by information gain, pruned on
the other third, and kept while they are precise; the ordered list becomes one CASE expression.
The statistics and the verdict run as built-in expressions, row by row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, without

BLANKS = " \t\n\x0b\x0c\r"
#: Words in a window that may repeat.
WINDOW = 5
#: Base rule: fewest words, and the largest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT = 10, 20
#: Labelled rows that the rules are learned from; chosen by a hash of the key.
TRAIN_ROWS = 20_000
#: Share of rejects a rule must have among what it covers in both thirds, and rows it must cover.
PRECISION, MIN_COVER = 0.9, 5
MAX_RULES, MAX_CONDITIONS = 16, 4
#: Candidate thresholds per statistic and growing step.
CUTS = 64

FEATURES = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "log_words": "log2(1 + n_words)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct"]


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Texts whose windows all hash differently have none;
    in others the windows are sorted by hash and words, and neighbours compared by their words."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    window = lambda i: F.slice(words, i + 1, WINDOW)

    def marked(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), window(i).alias("w"), i.alias("p"))))
        near = lambda s, x, i: F.coalesce((F.get(s, i)["h"] == x["h"]) & (F.get(s, i)["w"] == x["w"]), F.lit(False))
        places = let(order, lambda s: F.filter(F.transform(s, lambda x, i: F.when(near(s, x, i - 1) | near(s, x, i + 1), x["p"]).otherwise(-1)), lambda p: p >= 0))
        first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(p - a["at"], F.lit(WINDOW))).alias("n"))
        return F.aggregate(F.sort_array(places), first, step, lambda a: a["n"])

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of COUNTS (long). Null texts count as empty; clashing columns are replaced.

    Words are runs of anything but ASCII white space; lines are what newlines separate, and only
    lines with a word count.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    lost = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")
    out = without(docs, "_w", "_l", *COUNTS).withColumns({"_w": of_words, "_l": of_lines, "n_symbols": lost("[#*$%&|<>]+"), "n_upper": lost("[A-Z]+"), "n_marks": lost("[!?]+"), "n_digits": lost("[0-9]+")})
    return out.select("*", "_w.*", "_l.*").drop("_w", "_l")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.value if self.above else row[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _best_condition(rows: list[dict], p0: int, n0: int) -> tuple[float, Condition] | None:
    best = None
    for feature in FEATURES:
        ordered = sorted((r[feature], r["bad"]) for r in rows)
        p = n = 0
        step = max(1, len(ordered) // CUTS)
        for i, (value, bad) in enumerate(ordered):
            p, n = p + bad, n + (not bad)
            follows = ordered[i + 1][0] if i + 1 < len(ordered) else None
            if follows is None or follows == value or (i % step and bad == ordered[i + 1][1]):
                continue
            middle = (value + follows) / 2
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if q >= MIN_COVER and (best is None or _gain(q, m, p0, n0) > best[0]):
                    best = (_gain(q, m, p0, n0), Condition(feature, above, middle))
    return best


def _grow(rows: list[dict]) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0 or (found := _best_condition(rows, p0, n0)) is None or found[0] <= 0:
            break
        rule.append(found[1])
        rows = _covered((found[1],), rows)
    return tuple(rule)


def _precision(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    cover = _covered(rule, rows)
    bad = sum(r["bad"] for r in cover)
    return (bad + 1) / (len(cover) + 2), len(cover)


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drop last conditions as long as the covered rejects' share on the pruning rows doesn't fall."""
    while len(rule) > 1 and _precision(rule[:-1], rows)[0] >= _precision(rule, rows)[0]:
        rule = rule[:-1]
    return rule


def cover(rows: list[dict]) -> list[Rule]:
    """An ordered decision list that rejects; rows are dicts of the features, ``bad`` and ``part`` (0 to 2)."""
    grow, prune = [r for r in rows if r["part"]], [r for r in rows if not r["part"]]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(r["bad"] for r in grow):
        rule = _grow(grow)
        rule = _prune(rule, prune) if rule else rule
        if not rule:
            break
        share, n = _precision(rule, grow)
        checked, m = _precision(rule, prune)
        if share < PRECISION or n < MIN_COVER or (m >= MIN_COVER and checked < PRECISION - 0.1):
            break
        rules.append(rule)
        left = {id(r) for r in _covered(rule, grow)}
        grow = [r for r in grow if id(r) not in left]
        gone = {id(r) for r in _covered(rule, prune)}
        prune = [r for r in prune if id(r) not in gone]
    return rules


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Rules from at most TRAIN_ROWS labelled documents (label 0: reject), the lowest by a hash of the key.

    Null keys and null labels teach nothing; a key labelled twice counts once, as its lower label;
    of rows that repeat a key one teaches, the least by its statistics; no labels, or labels of one kind, give an empty list.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("l_key")).agg(F.min(label).alias("l_label"))
    sample = marked.orderBy(F.xxhash64("l_key"), "l_key").limit(TRAIN_ROWS)
    # The sample has TRAIN_ROWS rows of 16 bytes at most, so it is always small enough to broadcast.
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), F.col("k") == F.col("l_key"))
    part = F.pmod(F.xxhash64(F.col("k"), F.lit("part")), F.lit(3)).alias("part")
    stats = statistics(picked, "t").select("k", (F.col("l_label") == 0).alias("bad"), part, *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    # A key may repeat in docs; its least row teaches, so what comes to the driver stays TRAIN_ROWS rows.
    least = stats.groupBy("k").agg(F.min(F.struct(*FEATURES, "bad", "part")).alias("r")).select("k", "r.*")
    rows = sorted((r.asDict() for r in least.collect()), key=lambda r: r["k"])
    return cover(rows)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: the number of the first rule that fires, else null."""
    if not rules:
        return F.lit(None).cast("int")
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {k}" for k, rule in enumerate(rules))
    return F.expr(f"CASE {whens} END")


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add the counts, base_failed, rule (the first that rejects, or null) and kept.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; an
    empty list of rules leaves the base rule alone; clashing columns are replaced; texts of any
    length are judged whole.
    """
    found = statistics(without(docs, "base_failed", "rule", "kept"), text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
