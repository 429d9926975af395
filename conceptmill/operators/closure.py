"""Prerequisite closures by searches inside the tasks, over a graph of numbers that every task holds.

What is shared is two numbers of 32 bits and a name an edge and node, up to HELD_EDGES edges; targets
are spread over the cluster and searched in blocks of bounded size, and their pairs are not shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmill.checkpoints import checkpointed as cut

#: Edges that a task may hold; a larger graph is searched by a loop of joins.
HELD_EDGES = 1 << 25
#: Targets of a block, pairs that a block may hold before it is halved, rows of a batch handed on.
BLOCK, HELD_PAIRS, OUT_ROWS = 2048, 1 << 21, 1 << 16
#: Partitions for each core over which the targets are spread.
PER_CORE = 4


@dataclass
class Held:
    """Nodes numbered in the order of their names; the parents of node k are parents[first[k] : first[k + 1]]."""

    names: pa.Array
    first: np.ndarray
    parents: np.ndarray

    def parents_of(self, owner: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every parent of every node, each with its node's owner."""
        low, n = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        start = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(start - low, n)
        return np.repeat(owner, n), self.parents[at]

    def search(self, targets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(block, owner, ancestor, hop) for blocks of targets: all pairs, by the owner's place in the block, then ancestor."""
        nodes = len(self.names)
        todo = [targets[k : k + BLOCK] for k in range(0, len(targets), BLOCK)][::-1]
        while todo:
            block = todo.pop()
            owner, at = np.arange(len(block)), block
            seen, hops, hop = np.zeros(0, np.int64), np.zeros(0, np.int32), 0
            while len(at):
                hop += 1
                owner, at = self.parents_of(owner, at)
                keys = np.unique(owner * nodes + at)
                if len(seen):
                    place = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
                    keys = keys[seen[place] != keys]
                if len(seen) + len(keys) > HELD_PAIRS and len(block) > 1:
                    break
                place = np.searchsorted(seen, keys)
                seen, hops = np.insert(seen, place, keys), np.insert(hops, place, np.int32(hop))
                owner, at = keys // nodes, keys % nodes
            else:
                yield block, seen // nodes, seen % nodes, hops
                continue
            half = len(block) // 2
            todo += [block[half:], block[:half]]

    def teach(self, scope: np.ndarray, depth: np.ndarray, difficulty: np.ndarray) -> list[int]:
        """Topological order of one target's scope, as places in it: of what is ready, the deepest, easiest, least name first."""
        rank = np.empty(len(scope), np.int64)
        by_rank = np.lexsort((scope, difficulty, -depth))
        rank[by_rank] = np.arange(len(scope))
        owner, needs = self.parents_of(np.arange(len(scope)), scope)
        place = np.minimum(np.searchsorted(scope, needs), len(scope) - 1)
        inside = scope[place] == needs
        owner, place = owner[inside], place[inside]
        missing = np.bincount(owner, minlength=len(scope)).tolist()
        follow: list[list[int]] = [[] for _ in missing]
        for child, parent in zip(owner.tolist(), place.tolist(), strict=True):
            follow[parent].append(child)
        ranks, places = rank.tolist(), by_rank.tolist()
        heap = [ranks[k] for k, n in enumerate(missing) if not n]
        heapq.heapify(heap)
        order = []
        while heap:
            k = places[heapq.heappop(heap)]
            order.append(k)
            for c in follow[k]:
                missing[c] -= 1
                if not missing[c]:
                    heapq.heappush(heap, ranks[c])
        return order


def numbered(ids: DataFrame) -> DataFrame:
    """(id, code): distinct ids without nulls, numbered from 0 in their order."""
    rows = cut(ids.select("id").dropna().distinct().orderBy("id").select("id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("low")).orderBy("_p").collect()
    starts, done = [0] * (1 + max([r["_p"] for r in sizes], default=0)), 0
    for r in sizes:
        starts[r["_p"]], done = done - r["low"], done + r["n"]
    shift = F.array(*[F.lit(s).cast("long") for s in starts])
    return rows.select("id", (F.col("_m") + F.get(shift, F.col("_p"))).cast("int").alias("code"))


def coded(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """With the number of an id column; rows whose id has none drop."""
    lookup = codes.select(F.col("id").alias("_id"), F.col("code").alias(name)).hint("shuffle_hash")
    return df.join(lookup, F.col(column) == F.col("_id")).drop("_id")


def held(pairs: DataFrame, extra: DataFrame | None = None) -> tuple[Held, DataFrame]:
    """The graph of distinct (child, parent) pairs and its (id, code), with further ids."""
    ids = pairs.select(F.col("child").alias("id")).union(pairs.select("parent"))
    codes = numbered(ids if extra is None else ids.union(extra.select("id")))
    links = coded(coded(pairs.dropna(), "child", codes, "c"), "parent", codes, "p").select("c", "p").toArrow()
    # Names come in the order of their numbers, as far as partitions keep it; sorting makes sure of it.
    named = codes.toArrow()
    names = named.column("id").combine_chunks().take(pa.array(np.argsort(named.column("code").to_numpy(), kind="stable")))
    child, parent = (links.column(c).to_numpy() for c in ("c", "p"))
    order = np.lexsort((parent, child))
    first = np.concatenate(([0], np.cumsum(np.bincount(child, minlength=len(names)))))
    return Held(names, first, parent[order]), codes


def spread(targets: DataFrame, codes: DataFrame) -> DataFrame:
    """(code) of the targets that have a number, each once, over all cores."""
    n = PER_CORE * targets.sparkSession.sparkContext.defaultParallelism
    return coded(targets.select("id").distinct(), "id", codes, "code").select("code").repartition(n, "code")


def closure(graph: Held, codes: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, ancestor, hop) of the targets (id): everything reachable, at its least number of hops."""
    shared = targets.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for block, owner, at, hops in g.search(batch.column(0).to_numpy()):
                for low in range(0, len(at), OUT_ROWS):
                    part = slice(low, low + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([g.names.take(pa.array(block[owner[part]])), g.names.take(pa.array(at[part])), pa.array(hops[part])], names=["id", "ancestor", "hop"])

    return spread(targets, codes).mapInArrow(run, "id string, ancestor string, hop int")


def orders(graph: Held, codes: DataFrame, targets: DataFrame, difficulty: DataFrame, mastery: DataFrame, known_from: float | None) -> DataFrame:
    """(target, id, place, depth, mastery): each target's scope in teaching order, itself last.

    difficulty(id, difficulty) names the nodes, others are left out of the order; mastery(id, mastery)
    is 0 where there is none. With ``known_from`` what reaches it is left out too, but for the target.
    """
    n = len(graph.names)
    level = coded(difficulty, "id", codes, "code").select("code", F.coalesce(F.col("difficulty").cast("int"), F.lit(-(1 << 31))).alias("difficulty")).toArrow()
    hard, is_node = np.zeros(n, np.int32), np.zeros(n, bool)
    hard[level.column("code").to_numpy()] = level.column("difficulty").to_numpy()
    is_node[level.column("code").to_numpy()] = True
    m = coded(mastery, "id", codes, "code").select("code", F.col("mastery").cast("double")).filter("mastery != 0").toArrow()
    by_code = np.argsort(m.column("code").to_numpy(), kind="stable")
    found = m.column("code").to_numpy()[by_code], m.column("mastery").to_numpy()[by_code]
    shared = targets.sparkSession.sparkContext.broadcast((graph, hard, is_node, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, hard, is_node, (has, values) = shared.value

        def out(rows: list[tuple]) -> pa.RecordBatch:
            target, ids, place, depth, value = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([g.names.take(pa.array(target)), g.names.take(pa.array(ids)), pa.array(place.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(value)], names=["target", "id", "place", "depth", "mastery"])

        for batch in batches:
            for block, owner, at, hops in g.search(batch.column(0).to_numpy()):
                ends = np.searchsorted(owner, np.arange(len(block) + 1))
                rows, size = [], 0
                for k, target in enumerate(block):
                    scope, depth = at[ends[k] : ends[k + 1]], hops[ends[k] : ends[k + 1]]
                    own = scope != target
                    scope, depth = scope[own], depth[own]
                    spot = int(np.searchsorted(scope, target))
                    scope, depth = np.insert(scope, spot, target), np.insert(depth, spot, 0)
                    kept = is_node[scope]
                    scope, depth = scope[kept], depth[kept]
                    if not len(scope):
                        continue
                    order = np.array(g.teach(scope, depth, hard[scope]), np.int64)
                    scope, depth = scope[order], depth[order]
                    value = np.zeros(len(scope))
                    if len(has):
                        near = np.minimum(np.searchsorted(has, scope), len(has) - 1)
                        value = np.where(has[near] == scope, values[near], 0.0)
                    if known_from is not None:
                        stays = (value < known_from) | (scope == target)
                        scope, depth, value = scope[stays], depth[stays], value[stays]
                    rows.append((np.full(len(scope), target), scope, np.arange(len(scope)), depth, value))
                    size += len(scope)
                    if size >= OUT_ROWS:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return spread(targets, codes).mapInArrow(run, "target string, id string, place int, depth int, mastery double")
