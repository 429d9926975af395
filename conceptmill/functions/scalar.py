"""Column functions: decay, mastery, bands, status, names, identifiers, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-life, thresholds and display tables that results must agree on.
HALF_LIFE_DAYS = 60
BANDS = {"untouched": 0.0, "weak": 0.0, "learning": 0.35, "solid": 0.65, "mastered": 0.85}
BAND_COLORS = {"untouched": "#B4B2A9", "weak": "#E24B4A", "learning": "#EF9F27", "solid": "#97C459", "mastered": "#1D9E75"}
GAP_BELOW, MASTERED_FROM, PREREQUISITE_MET = 0.35, 0.85, 0.5
NODE_TYPES = ["Concept", "Technique", "Model", "Task", "Tool", "Paper", "Skill"]
RELATION_TYPES = ["prerequisite_of", "part_of", "related_to", "evolved_from", "applied_in", "implemented_by", "described_in", "confusable_with"]
EVIDENCE_TYPES = ["self_report", "quiz", "project", "conversation", "code"]
RELATION_STYLES = {
    "prerequisite_of": ("#185FA5", "", 1.8),
    "part_of": ("#0F6E56", "", 1.4),
    "related_to": ("#B4B2A9", "4,3", 1.0),
    "evolved_from": ("#534AB7", "6,3", 1.4),
    "applied_in": ("#D85A30", "", 1.2),
    "implemented_by": ("#888780", "2,3", 1.0),
    "described_in": ("#AFA9EC", "2,3", 1.0),
    "confusable_with": ("#D4537E", "3,3", 1.2),
}


def decay(last: Column, as_of: Column) -> Column:
    """0.5 to the power of whole days over the half-life; unknown, unreadable and future dates do not decay."""
    days = F.datediff(as_of, F.to_date(F.try_to_timestamp(last, F.lit("yyyy-MM-dd"))))
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / float(HALF_LIFE_DAYS)), F.lit(1.0))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def evidence_mastery(evidence: Column, last_touched: Column, as_of: Column) -> Column:
    """Noisy-or over the evidence that stands, each piece decayed by its own date; 4 decimals, 0 without any."""
    standing = F.filter(evidence, lambda e: ~F.coalesce(e["revoked"], F.lit(False)))
    missed = F.aggregate(standing, F.lit(1.0), lambda acc, e: acc * (1 - clipped(e["weight"]) * decay(F.coalesce(e["ts"], last_touched), as_of)))
    return F.when(F.size(standing) == 0, F.lit(0.0)).otherwise(F.round(1 - missed, 4))


def current_mastery(stored: Column, evidence: Column, last_touched: Column, as_of: Column) -> Column:
    """Any evidence, revoked or not, switches the stored score off; else the stored score decays."""
    has = F.coalesce(F.size(evidence) > 0, F.lit(False))
    return F.when(has, evidence_mastery(evidence, last_touched, as_of)).otherwise(F.round(stored * decay(last_touched, as_of), 4))


def band(m: Column) -> Column:
    return F.when(m <= 0, "untouched").when(m < BANDS["learning"], "weak").when(m < BANDS["solid"], "learning").when(m < BANDS["mastered"], "solid").otherwise("mastered")


def band_color(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BAND_COLORS.items() for x in pair])[name]


def status(m: Column) -> Column:
    """known, learning or gap: the path's view of a mastery."""
    return F.when(m >= MASTERED_FROM, "known").when(m >= GAP_BELOW, "learning").otherwise("gap")


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "\\s+", " ")


def slug(name: Column) -> Column:
    """An identifier from a name: runs of other characters become one underscore; none left: x and a hash."""
    plain = F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(plain == "", F.concat(F.lit("x"), F.substring(F.md5(name), 1, 6))).otherwise(plain)


def shortened(text: Column, limit: int = 80) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def verified_quote(quote: Column, chunk: Column, limit: int = 240) -> Column:
    """The quote, cut to the limit, if the chunk contains it exactly; else empty."""
    return F.when((F.length(quote) > 0) & F.contains(chunk, quote), F.substring(quote, 1, limit)).otherwise("")


def mentions(keyword: str, node_id: Column, name: Column, aliases: Column) -> Column:
    """Substring search in id, name and aliases, without regard to case or outer blanks."""
    k = keyword.strip().lower()
    texts = F.concat(F.array(node_id, name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(k)))
