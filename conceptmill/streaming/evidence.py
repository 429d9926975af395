"""Continuous evidence: streaming mastery inputs and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "user_id long, concept_id string, seq long, action string, weight double, ts string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The evidence log as a stream of Parquet files."""
    return spark.readStream.schema(LOG).parquet(path)


def append(stream: DataFrame, table: str, checkpoint: str):
    """Append the stream's rows to a Parquet table; each file's rows arrive once."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(log: DataFrame) -> DataFrame:
    """The log's standing and revoked evidence: each revoke_last takes back the newest piece that stands.

    Within a learner and concept, actions apply in arrival order like brackets: an add is revoked
    if some later revoke finds it on top. Depths come from a running sum, so no rows are gathered.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "concept_id").orderBy("seq")
    step = F.when(F.col("action") == "add", 1).otherwise(-1)
    depth = log.withColumn("raw", F.sum(step).over(w)).withColumn("low", F.least(F.min("raw").over(w), F.lit(0)))
    level = depth.withColumn("level", F.col("raw") - F.col("low"))
    # An add at a level stands unless the level later falls below it.
    after = Window.partitionBy("user_id", "concept_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    lowest = level.withColumn("later", F.min(F.col("level")).over(after))
    return lowest.filter("action = 'add'").select("user_id", "concept_id", "seq", "weight", "ts", F.coalesce(F.col("later") < F.col("level"), F.lit(False)).alias("revoked"))


def _stack(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    weights, dates, revoked = (list(x) for x in state.get) if state.exists else ([], [], [])
    for frame in frames:
        for r in frame.sort_values("seq").itertuples():
            if r.action == "add":
                weights.append(float(r.weight)), dates.append(r.ts), revoked.append(False)
            elif False in revoked:
                revoked[len(revoked) - 1 - revoked[::-1].index(False)] = True
    state.update((weights, dates, revoked))
    standing = [(w, d) for w, d, x in zip(weights, dates, revoked, strict=True) if not x]
    yield pd.DataFrame({"user_id": [key[0]], "concept_id": [key[1]], "standing": [len(standing)], "total": [len(weights)]})


def stateful(stream: DataFrame) -> DataFrame:
    """Running counts of standing evidence per learner and concept; state keeps the list, as every
    piece ages on its own and a revocation needs the newest."""
    return stream.groupBy("user_id", "concept_id").applyInPandasWithState(_stack, "user_id long, concept_id string, standing long, total long", "weights array<double>, dates array<string>, revoked array<boolean>", "update", "NoTimeout")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; the watermark only bounds state when the input is a stream."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    counts = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per learner and session."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
