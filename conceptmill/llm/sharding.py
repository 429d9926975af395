"""Sharding by longest processing time: groups of equal texts, by falling size, to the least-loaded shard.

Groups of one size are interchangeable, so the schedule works on runs of equal sizes: the driver
sees each distinct size once per range partition (sizes that sum to T bytes have at most
sqrt(2 T) distinct values), never the groups. Small runs go through the heap one by one, long
runs are dealt by filling the loads to a common level, which gives the same loads.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Runs up to this many groups per shard go through the heap one by one.
HEAP_ROUNDS = 4
#: Rows that share a numbering bucket, over all shards.
BUCKET_ROWS = 10_000


def schedule(sizes: list[int], counts: list[int], shards: int) -> tuple[list[list[int]], list[int]]:
    """For runs of equal sizes in falling order: groups of each run per shard, and the final loads."""
    heap = [(0, k) for k in range(shards)]
    dealt = []
    for size, count in zip(sizes, counts, strict=True):
        share = [0] * shards
        if count > HEAP_ROUNDS * shards:
            loads = np.zeros(shards, np.int64)
            for load, k in heap:
                loads[k] = load
            # The largest level such that filling every shard up to it takes no more than the run.
            low, high = int(loads.min()), int(loads.max()) + size * (count // shards + 1)
            while low < high:
                level = (low + high + 1) // 2
                if int(np.maximum(0, -(-(level - loads) // size)).sum()) <= count:
                    low = level
                else:
                    high = level - 1
            whole = np.maximum(0, -(-(low - loads) // size))
            share = whole.tolist()
            count -= int(whole.sum())
            heap = [(int(loads[k]) + share[k] * size, k) for k in range(shards)]
            heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            share[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        dealt.append(share)
    loads = [0] * shards
    for load, k in heap:
        loads[k] = load
    return dealt, loads


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of docs.

    Size is the text's UTF-8 bytes plus 8; a null text counts, and groups, as an empty one.
    Equal texts share a shard; sizes per shard are near equal as far as the largest group allows.
    Slots number each shard's rows from 0 without gaps. Repeated rows each get a slot; null keys
    are kept; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = checkpointed(
        docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("grp"))
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    # A row's id is its range partition (upper bits) and its place in it, frozen by the checkpoint.
    placed = checkpointed(groups.repartitionByRange(F.col("bytes").desc(), F.col("grp")).sortWithinPartitions(F.col("bytes").desc(), "grp").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    runs = sorted(placed.groupBy(part.alias("part"), "bytes").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect(), key=lambda r: r["first"])
    dealt, _ = schedule([r["bytes"] for r in runs], [r["n"] for r in runs], shards)
    ladder = [(r["part"], r["bytes"], r["first"], np.cumsum(s).tolist()) for r, s in zip(runs, dealt, strict=True)]
    steps = spark.createDataFrame(ladder, "r_part long, r_bytes long, first long, upto array<long>")
    at = F.col("id") - F.col("first")
    shard = F.size(F.filter("upto", lambda x: x <= at))
    homes = placed.withColumn("part", part).join(steps, [F.col("part") == F.col("r_part"), F.col("bytes") == F.col("r_bytes")]).select(F.col("grp").alias("home"), shard.alias("shard"))
    # A group with very many rows is split at run time by the adaptive skew join.
    dealt_rows = rows.join(homes.hint("merge"), F.col("grp") == F.col("home")).drop("grp", "home")
    # Rows are numbered within (bucket, shard): buckets of a hash of the key, so none holds a hot group.
    dealt = checkpointed(dealt_rows.withColumn("id", F.monotonically_increasing_id()))
    buckets = dealt.count() // BUCKET_ROWS + 1
    numbered = dealt.withColumn("part", F.pmod(F.xxhash64("key", "id"), F.lit(buckets)))
    counts = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("b_part"), F.col("shard").alias("b_shard"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy("key", "id")) - 1
    placed_rows = numbered.withColumn("place", place).join(before.hint("merge"), [F.col("part") == F.col("b_part"), F.col("shard") == F.col("b_shard")])
    return placed_rows.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
