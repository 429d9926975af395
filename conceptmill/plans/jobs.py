"""Jobs over files: a payload into the patch layer, suggestions into the staging folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.operators import graph as G
from conceptmill.operators import ingest as I
from conceptmill.sources import files as X

# The layers' file names.
SEED, GENERATED = "seed_ontology.yaml", "ontology_generated.yaml"


def differences(old: G.Graph, nodes: DataFrame, edges: DataFrame) -> tuple[list[dict], list[dict]]:
    """(node entries, edge entries) of a patch layer: new rows whole, changed nodes with the changed fields only.

    A patch is of the payload's size, so it may come to the driver.
    """
    fields = ["name", "type", "domain", "desc", "difficulty", "aliases", "evidence_refs"]
    found = I.patch_diff(I.with_refs(old.nodes), nodes, ["id"], fields).join(nodes, "id").orderBy("ord").collect()
    entries = [{"id": r["id"], **{k: v for k, v in r.asDict(recursive=True).items() if k in r["fields"]}} for r in found]
    key = ["source", "target", "type"]
    rest = ["confidence", "note", "evidence_refs"]
    changed = I.patch_diff(I.with_refs(old.edges), edges, key, rest).select(*key).join(edges, key).orderBy("ord").collect()
    return entries, [{k: r.asDict(recursive=True)[k] for k in (*key, *rest)} for r in changed]


def ingest_file(spark: SparkSession, payload: str, folder: str, dry_run: bool = False, embed: Callable | None = None) -> DataFrame:
    """Merge a payload into the layers of a folder; what is new goes to the patch layer. The report's rows.

    A cycle of prerequisites after the merge raises ValueError; a dry run writes nothing, and neither
    does a payload that changes nothing.
    """
    patch = os.path.join(folder, GENERATED)
    old = X.read_layers(spark, os.path.join(folder, SEED), patch)
    new_nodes, new_edges, source = X.read_payload(spark, payload)
    nodes, edges, report = I.merge_payload(old.nodes, old.edges, new_nodes, new_edges, source, embed)
    if found := G.cycles(G.Graph(nodes, edges)):
        raise ValueError(f"prerequisite cycles after the merge: {found}")
    report = G.cut(report)
    if not dry_run:
        X.write_patch(patch, *differences(old, nodes, edges))
    return report.select("kind", "item", F.coalesce("reason", F.lit("")).alias("reason"))
