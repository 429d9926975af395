"""Candidates for missing prerequisites: roots, and names that descriptions mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, roots

#: Characters of a name that index it among the substrings of descriptions.
GRAM = 3


def root_candidates(g: Graph, limit: int = 12) -> DataFrame:
    """Roots by how much they unlock, then id."""
    out = g.prerequisites.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("unlocks"))
    return roots(g).join(out, "id").join(g.nodes.select("id"), "id", "left_semi").orderBy(F.desc("unlocks"), "id").limit(limit)


def candidates(g: Graph, limit: int = 12) -> DataFrame:
    """(ord, id, name, domain, desc, unlock_count, mentioned_ids): the roots that unlock most, with up to
    five nodes that their descriptions name, in order."""
    first = root_candidates(g, limit).join(g.nodes.select("ord", "id", "name", "domain", "desc"), "id")
    named = mentions(g.nodes, wanted=first.select("ord")).join(g.nodes.select(F.col("ord").alias("named_ord"), F.col("id").alias("named")), "named_ord")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "named"))), lambda s: s["named"])
    gathered = named.groupBy("ord").agg(ids.alias("mentioned_ids"))
    none = F.array().cast("array<string>")
    return first.join(gathered, "ord", "left").select("ord", "id", "name", "domain", "desc", F.col("unlocks").alias("unlock_count"), F.coalesce("mentioned_ids", none).alias("mentioned_ids"))


def mentions(nodes: DataFrame, limit: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """(ord, named_ord, mention, place): nodes, those with a wanted ord if they are given, whose description contains another name, the first ``limit`` in order.

    An equi-join on the name's first characters instead of comparing every pair: descriptions
    list the grams they contain once each, and containment of the whole name is verified. Of
    nodes that share a name the last counts, at the first one's place.
    """
    names = nodes.filter(F.length("name") > 0).groupBy("name").agg(F.max("ord").alias("named_ord"), F.min("ord").alias("place")).select(F.col("name").alias("mention"), "named_ord", "place", F.substring("name", 1, GRAM).alias("gram"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("desc")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("desc", i, n)))))
    texts = (nodes if wanted is None else nodes.join(wanted, "ord", "left_semi")).filter(F.length("desc") > 0).select("ord", "name", "desc", F.explode(grams).alias("gram"))
    found = texts.join(names, "gram").filter(F.contains("desc", "mention") & (F.col("name") != F.col("mention")))
    w = Window.partitionBy("ord").orderBy("place")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).select("ord", "named_ord", "mention", "place")
