"""Learner operators: mastery from evidence, profiles, evidence updates.

learner_state(user_id, concept_id, mastery, confidence, evidence, last_touched, source)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S


def mastery(states: DataFrame, as_of: str | Column) -> DataFrame:
    """(user_id, concept_id, mastery) on a day."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return states.select("user_id", "concept_id", S.current_mastery(F.col("mastery"), F.col("evidence"), F.col("last_touched"), day).alias("mastery"))


def mastery_from_log(log: DataFrame, as_of: str) -> DataFrame:
    """The same from one row per piece of evidence (user_id, concept_id, weight, ts, revoked).

    One hash aggregation with partial products on the map side, so a hot learner or concept
    costs a row per task.
    """
    d = S.decay(F.col("ts").cast("string"), F.to_date(F.lit(as_of)))
    factor = F.when(F.coalesce("revoked", F.lit(False)), F.lit(1.0)).otherwise(1 - S.clipped(F.col("weight")) * d)
    return log.groupBy("user_id", "concept_id").agg(F.round(1 - F.product(factor), 4).alias("mastery"))


def with_mastery(nodes: DataFrame, one: DataFrame) -> DataFrame:
    """Nodes with one learner's mastery; 0 where nothing is known."""
    known = one.select(F.col("concept_id").alias("id"), F.col("mastery").alias("_m"))
    return nodes.join(known, "id", "left").withColumn("mastery", F.coalesce("_m", F.lit(0.0))).drop("_m")


def band_profile(nodes: DataFrame, one: DataFrame) -> DataFrame:
    """All five bands with their counts and share of the touched average."""
    spark = nodes.sparkSession
    m = with_mastery(nodes, one).select(S.band(F.col("mastery")).alias("band"), "mastery")
    counts = m.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("mastery"), 4).alias("avg_mastery"))
    dim = spark.createDataFrame([(b, c, i) for i, (b, c) in enumerate(S.BAND_COLORS.items())], "band string, color string, place int")
    return dim.join(counts, "band", "left").select("band", "color", "place", F.coalesce("n", F.lit(0)).alias("n"), "avg_mastery")


def profile(nodes: DataFrame, one: DataFrame) -> DataFrame:
    """(band, n, ids, total, touched, avg_mastery): every band with its nodes in order, and the totals of all of them."""
    m = with_mastery(nodes, one).withColumn("band", S.band(F.col("mastery")))
    bands = m.groupBy("band").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("ids"))
    touched = F.when(F.col("mastery") > 0, F.col("mastery"))
    total = m.agg(F.count("*").alias("total"), F.count(touched).alias("touched"), F.coalesce(F.round(F.round(F.avg(touched), 8), 3), F.lit(0.0)).alias("avg_mastery"))
    dim = nodes.sparkSession.createDataFrame([(b,) for b in S.BANDS], "band string")
    full = dim.join(bands, "band", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return full.join(F.broadcast(total)).select("band", F.size("ids").alias("n"), "ids", "total", "touched", "avg_mastery")


def recorded_average(states: DataFrame, as_of: str) -> DataFrame:
    """(user_id, recorded, average): what is on record for each learner, and its mean mastery on a day."""
    return mastery(states, as_of).groupBy("user_id").agg(F.count("*").alias("recorded"), F.avg("mastery").alias("average"))


def domain_overview(nodes: DataFrame, one: DataFrame) -> DataFrame:
    m = with_mastery(nodes, one)
    touched = F.when(F.col("mastery") > 0, F.col("mastery"))
    return m.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.round(F.avg(touched), 8), 3).alias("avg_mastery"), F.count_if(F.col("mastery") <= 0).alias("untouched"), F.min("ord").alias("first_ord"))


def text_summary(nodes: DataFrame, one: DataFrame, names: int = 12) -> DataFrame:
    """Per band: the count and the first names in order."""
    m = with_mastery(nodes, one).withColumn("band", S.band(F.col("mastery")))
    w = Window.partitionBy("band").orderBy("name", "id")
    ranked = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= names)
    joined = ranked.groupBy("band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return m.groupBy("band").agg(F.count("*").alias("n")).join(joined, "band")


def latest_standing(log: DataFrame) -> DataFrame:
    """The newest evidence, by arrival, that is not revoked, per learner and concept."""
    return log.filter("not revoked").groupBy("user_id", "concept_id").agg(F.max_by(F.struct("seq", "weight", "ts"), "seq").alias("e")).select("user_id", "concept_id", "e.*")


def revoke_latest(log: DataFrame) -> DataFrame:
    """The log after revoking each learner's and concept's newest standing evidence."""
    last = latest_standing(log).select("user_id", "concept_id", F.col("seq").alias("_seq"))
    return log.join(last, ["user_id", "concept_id"], "left").withColumn("revoked", F.col("revoked") | F.coalesce(F.col("seq") == F.col("_seq"), F.lit(False))).drop("_seq")


def mark(states: DataFrame, user_id: str, concept_id: str, as_of: str, score: float | None = None, evidence: list[tuple] | None = None, source: str = "self_report") -> DataFrame:
    """States after new evidence, (type, desc, weight) tuples, or an explicit score.

    Old evidence without a date is frozen at the old touch date; a state with a score and no
    evidence first turns it into evidence; a score revokes all earlier evidence and stands alone.
    """
    kind = "array<struct<type:string,desc:string,weight:double,ts:string,revoked:boolean>>"
    mine = (F.col("user_id") == user_id) & (F.col("concept_id") == concept_id)
    spark = states.sparkSession
    blank = spark.createDataFrame([(user_id, concept_id, 0.0, 0.3, None, None, source)], "user_id string, concept_id string, mastery double, confidence double, evidence string, last_touched string, source string").withColumn("evidence", F.array().cast(kind)).select(states.columns)
    base = states.unionByName(blank.join(states.filter(mine).select("user_id", "concept_id"), ["user_id", "concept_id"], "left_anti").select(states.columns))
    old = F.coalesce("evidence", F.array().cast(kind))
    legacy = F.array(F.struct(F.lit("self_report").alias("type"), F.lit("earlier score").alias("desc"), F.col("mastery").alias("weight"), F.col("last_touched").alias("ts"), F.lit(False).alias("revoked"))).cast(kind)
    old = F.when((F.size(old) == 0) & (F.col("mastery") > 0), legacy).otherwise(old)
    frozen = F.transform(old, lambda e: F.struct(e["type"].alias("type"), e["desc"].alias("desc"), e["weight"].alias("weight"), F.coalesce(e["ts"], F.col("last_touched")).alias("ts"), (F.coalesce(e["revoked"], F.lit(False)) | F.lit(score is not None)).alias("revoked")))
    fresh = [(source, "score", float(score))] if score is not None else evidence or []
    added = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(d).alias("desc"), F.lit(float(w)).alias("weight"), F.lit(as_of).alias("ts"), F.lit(False).alias("revoked")) for t, d, w in fresh]).cast(kind)
    everything = F.concat(frozen, added)
    value = S.evidence_mastery(everything, F.lit(as_of), F.to_date(F.lit(as_of)))
    return base.withColumns({
        "evidence": F.when(mine, everything).otherwise(F.col("evidence")),
        "mastery": F.when(mine, value).otherwise(F.col("mastery")),
        "last_touched": F.when(mine, F.lit(as_of)).otherwise(F.col("last_touched")),
        "source": F.when(mine, F.lit(source)).otherwise(F.col("source")),
    })
