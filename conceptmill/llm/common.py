"""Shared plumbing of the corpus operators: reading, checkpoints, Arrow chunking, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.checkpoints import checkpointed

#: Bytes of text that one vectorised step works on; numpy temporaries are a small multiple of it.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Without it, Catalyst inlines an array expression into a lambda body and evaluates it anew
    for every element.
    """
    return F.transform(F.array(value), body)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns (any case) whose names an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def string_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text: (slice, bytes, offsets).

    Nulls count as empty. One text is never split, so a chunk exceeds the limit only by one text.
    """
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(array):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(array))
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (longs); root is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two aggregations and two
    joins on the edge list, the edge count never grows beyond the input's, and a hub's edges are
    split by the adaptive skew join, since neither step gathers a neighbourhood into one row.
    Every round is checkpointed, so a lost executor costs one round at most. It ends when a round
    changes nothing, which the count and a sum of the rows' hashes show; any long can be an id.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
        side = both.filter("b > a") if large else both
        linked = side.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            linked = linked.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return linked.filter("a != b").distinct()

    spark = edges.sparkSession
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    current = checkpointed(ordered)
    mark = None
    while True:
        current = checkpointed(star(star(current, True), False))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    if mark[0] == 0:
        return spark.createDataFrame([], "node long, root long")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


__all__ = ["CHUNK_BYTES", "arrow_schema", "checkpointed", "connected_components", "let", "string_chunks", "table", "without"]
