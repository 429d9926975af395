"""Learning paths: recommendation, readiness, teaching order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S

from . import closure
from .graph import Graph, ancestors, cut, cycles
from .learner import with_mastery


def ready(g: Graph, one: DataFrame) -> DataFrame:
    """Nodes all of whose direct prerequisites reach the threshold; nodes without any are ready."""
    m = one.select(F.col("concept_id").alias("source"), "mastery")
    unmet = g.prerequisites.join(m, "source", "left").filter(F.coalesce("mastery", F.lit(0.0)) < S.PREREQUISITE_MET)
    return g.nodes.join(unmet.select(F.col("target").alias("id")), "id", "left_anti")


def recommend_next(g: Graph, one: DataFrame, limit: int = 5) -> DataFrame:
    """What to learn next: not mastered, prerequisites met; most dependents first, then easiest, then order."""
    unlocks = g.prerequisites.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("unlocks"))
    open_ = with_mastery(ready(g, one), one).filter(F.col("mastery") < S.MASTERED_FROM)
    scored = open_.join(unlocks, "id", "left").withColumn("unlocks", F.coalesce("unlocks", F.lit(0)))
    return scored.select("id", "name", "domain", "difficulty", "mastery", S.status(F.col("mastery")).alias("status"), "unlocks", "ord").orderBy(F.desc("unlocks"), "difficulty", "ord").limit(limit)


def readiness(g: Graph, one: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: ancestors that are gaps, need review or are fine, and the verdict."""
    known = one.select(F.col("concept_id").alias("ancestor"), "mastery")
    up = ancestors(g.prerequisites, targets).join(known, "ancestor", "left").withColumn("m", F.coalesce("mastery", F.lit(0.0)))
    counts = up.groupBy("id").agg(F.count_if(F.col("m") < S.GAP_BELOW).alias("gaps"), F.count_if((F.col("m") >= S.GAP_BELOW) & (F.col("m") < S.PREREQUISITE_MET)).alias("reviews"), F.count("*").alias("total"))
    out = targets.select("id").distinct().join(counts, "id", "left").fillna(0, ["gaps", "reviews", "total"])
    return out.withColumn("verdict", F.when(F.col("gaps") > 0, "not_ready").when(F.col("reviews") > 0, "needs_review").otherwise("ready"))


def _teach(scope: list) -> list[str]:
    """Topological order of one target's scope: of what is ready, the deepest, easiest, least id first."""
    info = {r["id"]: r for r in scope}
    waits = {k: [p for p in (r["needs"] if r["needs"] is not None else []) if p in info] for k, r in info.items()}
    missing = {k: len(v) for k, v in waits.items()}
    follow: dict[str, list[str]] = {}
    for k, v in waits.items():
        for p in v:
            follow.setdefault(p, []).append(k)
    key = lambda k: (-info[k]["depth"], info[k]["difficulty"], k)
    heap = [key(k) for k, n in missing.items() if not n]
    heapq.heapify(heap)
    order = []
    while heap:
        k = heapq.heappop(heap)[2]
        order.append(k)
        for c in follow.get(k, ()):
            missing[c] -= 1
            if not missing[c]:
                heapq.heappush(heap, key(c))
    return order


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A scope at a time becomes Python objects; a batch of them would be gigabytes."""
    for batch in batches:
        ids = pa.array((_teach(batch.column(1)[k].as_py()) for k in range(batch.num_rows)), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["target", "ids"])


def learning_paths(g: Graph, one: DataFrame, targets: DataFrame, include_known: bool = True) -> DataFrame:
    """(target, id, place, depth, mastery, status): each target's prerequisites in teaching order, itself last.

    Depth is the least number of hops to the target. Scopes are single prerequisite closures, so
    a group per target fits a task; targets are spread over the cluster. Up to closure.HELD_EDGES
    edges a task searches and orders its targets by itself, in blocks of bounded size.
    """
    goals = targets.select("id").distinct()
    pairs = cut(g.prerequisites.select(F.col("target").alias("child"), F.col("source").alias("parent")).dropna().distinct())
    if pairs.count() <= closure.HELD_EDGES:
        graph, codes = closure.held(pairs, goals)
        level = g.nodes.select("id", "difficulty")
        path = closure.orders(graph, codes, goals, level, one.select(F.col("concept_id").alias("id"), "mastery"), None if include_known else S.MASTERED_FROM)
        return path.withColumn("status", S.status(F.col("mastery")))
    scope = ancestors(g.prerequisites, goals).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.col("hop").alias("depth"))
    scope = scope.filter("id != target").unionByName(goals.select(F.col("id").alias("target"), "id", F.lit(0).alias("depth")))
    needs = g.prerequisites.groupBy(F.col("target").alias("id")).agg(F.collect_set("source").alias("needs"))
    rows = scope.join(needs, "id", "left").join(g.nodes.select("id", "difficulty"), "id")
    scopes = rows.groupBy("target").agg(F.collect_list(F.struct("id", "depth", "difficulty", "needs")).alias("scope"))
    steps = scopes.mapInArrow(_orders, "target string, ids array<string>").select("target", F.posexplode("ids").alias("step", "id"))
    full = with_mastery(steps.join(scope, ["target", "id"]), one).withColumn("status", S.status(F.col("mastery")))
    if not include_known:
        full = full.filter((F.col("status") != "known") | (F.col("id") == F.col("target")))
    return full.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("step")) - 1).select("target", "id", "place", "depth", "mastery", "status")


def path_counters(path: DataFrame) -> DataFrame:
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "gap", F.struct("place", "id")))), lambda s: s["id"])
    return path.groupBy("target").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "gap").alias("gap_count"), F.count_if(F.col("status") == "known").alias("known_count"), F.array_join(gaps, ",").alias("gaps"))


def learning_path(g: Graph, target: str, one: DataFrame, include_known: bool = True) -> DataFrame:
    """One target's path; KeyError for an unknown target, ValueError with up to three cycles if there are any."""
    goal = g.nodes.filter(F.col("id") == target).select("id")
    if goal.isEmpty():
        raise KeyError(target)
    if found := cycles(g):
        raise ValueError(f"prerequisite cycles: {found}")
    return learning_paths(g, one, goal, include_known)
