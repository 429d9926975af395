"""Edges that are implied by groups: every two members of a clique are joined.

A clique of n members stands for n (n - 1) / 2 edges. What only counts or looks up edges is worked out
from the members; what lists them makes them where the clique's members meet, without a shuffle of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources that one block of a clique has at most, so that no task holds more of a large clique.
BLOCK = 4096
#: Partitions for each core in which the members of cliques meet.
PER_CORE = 4


@dataclass
class Cliques:
    """members(clique, place, id): an id is in one clique at most and once; of two members the one of
    lesser place points to the other."""

    members: DataFrame
    type: str
    confidence: float

    def rows(self, pairs: DataFrame) -> DataFrame:
        """Pairs (source, target) as edges."""
        kind = F.lit(self.type)
        return pairs.select("source", "target", kind.alias("type"), F.lit(self.confidence).alias("confidence"), F.xxhash64("source", "target", kind).alias("ord"), F.lit("").alias("note"))

    def edges(self) -> DataFrame:
        return self.rows(paired(self.members))

    def degree(self) -> DataFrame:
        """(id, degree) of the members that are not alone."""
        return self.members.select("id", (F.count("*").over(Window.partitionBy("clique")) - 1).alias("degree")).filter("degree > 0")

    def count(self) -> DataFrame:
        """One row (n): the number of edges."""
        return self.members.groupBy("clique").agg(F.count("*").alias("n")).agg(F.expr("coalesce(sum(n * (n - 1) div 2), 0)").alias("n"))

    def met(self, pairs: DataFrame) -> DataFrame:
        """(source, target): the clique edges between the ends of given pairs (source, target), in either direction."""
        m = self.members
        both = pairs.select("source", "target").union(pairs.select("target", "source"))
        first = both.join(m.select("clique", F.col("place").alias("_a"), F.col("id").alias("source")), "source")
        return first.join(m.select("clique", F.col("place").alias("_b"), F.col("id").alias("target")), ["clique", "target"]).filter("_a < _b").select("source", "target").distinct()

    def rest(self, met: DataFrame, *, members: DataFrame | None = None, carried: tuple[str, ...] = (), both_ways: bool = False) -> DataFrame:
        """(source, target, what the target carries): the edges that are not among the met ones."""
        taken = met.groupBy(F.col("target").alias("id")).agg(F.collect_set("source").alias("_taken"))
        if both_ways:
            taken = met.select("source", "target").union(met.select("target", "source")).groupBy(F.col("target").alias("id")).agg(F.collect_set("source").alias("_taken"))
        m = (self.members if members is None else members).join(taken, "id", "left")
        free = F.col("_taken").isNull() | ~F.array_contains("_taken", F.col("source"))
        return paired(m, (*carried, "_taken"), both_ways).filter(free).drop("_taken")

    def around(self, ids: DataFrame) -> DataFrame:
        """(near, id): the other members of the cliques of given ids."""
        m = self.members
        mine = m.join(ids.select("id").distinct(), "id", "left_semi").select("clique", F.col("place").alias("_own"), F.col("id").alias("near"))
        return mine.join(m, "clique").filter("place != _own").select("near", "id")


def paired(members: DataFrame, carried: tuple[str, ...] = (), both_ways: bool = False) -> DataFrame:
    """(source, target, carried columns of the target): every two members of a clique, made where they meet.

    Sources are dealt into blocks and targets go to all blocks of their clique; the targets of a
    partition are held, in proportion to the members, and the pairs only stream.
    """
    blocks = F.ceil(F.count("*").over(Window.partitionBy("clique")) / BLOCK).cast("int")
    m = members.withColumn("_blocks", blocks)
    sources = m.select("clique", F.pmod(F.xxhash64("place"), F.col("_blocks")).cast("int").alias("_block"), F.col("place").alias("_from"), F.col("id").alias("source"))
    targets = m.select("clique", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("place").alias("_to"), F.col("id").alias("target"), *carried)
    n = PER_CORE * members.sparkSession.sparkContext.defaultParallelism
    dealt = [x.repartition(n, "clique", "_block") for x in (sources, targets)]
    met = dealt[0].join(dealt[1].hint("shuffle_hash"), ["clique", "_block"]).filter(F.col("_from") != F.col("_to") if both_ways else F.col("_from") < F.col("_to"))
    return met.select("source", "target", *carried)
