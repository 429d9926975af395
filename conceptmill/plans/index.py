"""The paired index of nodes and communities: built, stored under one manifest, loaded only if it still fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.operators import communities as C
from conceptmill.operators import graph as G
from conceptmill.operators import vectors as V
from conceptmill.operators.embedders import HashEmbedder

MEMBERS = ["id", "ord", "community", "size", "members", "hubs", "summary"]


@dataclass
class Index:
    """nodes(id, ord, vector, name_vector), communities(MEMBERS, vector), and the signature of what they were made from."""

    nodes: DataFrame
    communities: DataFrame
    signature: str

    @property
    def names(self) -> DataFrame:
        return self.nodes.select("id", F.col("name_vector").alias("vector"))


def signature(g: G.Graph, one: DataFrame, embedder) -> str:
    return V.signature(g.nodes, g.edges, one, embedder.identity()).first()["signature"]


def build(g: G.Graph, one: DataFrame, embedder=None) -> Index:
    """Embed every node's text and name, and every community's summary."""
    embedder = embedder or HashEmbedder()
    text = V.node_text(g.nodes)
    names = embedder.embed(g.nodes, "id", "name").withColumnRenamed("vector", "name_vector")
    nodes = embedder.embed(text, "id", "text").join(names, "id").join(g.nodes.select("id", "ord"), "id")
    made = G.cut(C.all_communities(g, one))
    communities = embedder.embed(made, "id", "summary").join(made.select(*MEMBERS), "id")
    return Index(nodes.select("id", "ord", "vector", "name_vector"), communities, signature(g, one, embedder))


def save(index: Index, path: str) -> None:
    """Both tables, then the manifest with the signature and the counts: a half-written index has none that fits."""
    index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    index.communities.write.mode("overwrite").parquet(f"{path}/communities")
    spark = index.nodes.sparkSession
    counts = [spark.read.parquet(f"{path}/{t}").count() for t in ("nodes", "communities")]
    spark.createDataFrame([(index.signature, *counts)], "signature string, nodes long, communities long").write.mode("overwrite").parquet(f"{path}/manifest")


def strangers(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, side): identifiers that only the index or only the graph has; none if the sets are equal."""
    ours, theirs = index.select("id").distinct(), nodes.select("id").distinct()
    return ours.join(theirs, "id", "left_anti").withColumn("side", F.lit("index")).unionByName(theirs.join(ours, "id", "left_anti").withColumn("side", F.lit("graph")))


def load(spark: SparkSession, path: str, g: G.Graph, one: DataFrame, embedder=None) -> Index | None:
    """The stored index if its signature, counts, columns and identifiers fit graph, mastery and embedder; else None."""
    embedder = embedder or HashEmbedder()
    try:
        manifest = spark.read.parquet(f"{path}/manifest").first()
        nodes, communities = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "communities"))
    except Exception:  # noqa: BLE001  a missing or broken index is a stale one
        return None
    if manifest is None or manifest["signature"] != signature(g, one, embedder):
        return None
    if {"id", "ord", "vector", "name_vector"} - set(nodes.columns) or {*MEMBERS, "vector"} - set(communities.columns):
        return None
    if (nodes.count(), communities.count()) != (manifest["nodes"], manifest["communities"]) or not strangers(nodes, g.nodes).isEmpty():
        return None
    return Index(nodes, communities, manifest["signature"])


def load_or_build(spark: SparkSession, path: str, g: G.Graph, one: DataFrame, embedder=None, rebuild: bool = False) -> tuple[Index, bool]:
    """(index, whether it was built now): the stored one if it fits, else a new one, stored and read back."""
    if not rebuild and (found := load(spark, path, g, one, embedder)) is not None:
        return found, False
    made = build(g, one, embedder)
    save(made, path)
    return Index(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/communities"), made.signature), True
