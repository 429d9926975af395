"""Readers and writers: ontologies, layers, payloads, learners, indexes, notes, exports.

Configuration-sized files (ontologies, payloads, one learner) are parsed on the driver; notes are
read by the cluster through the binaryFile source. Tables are written as Parquet.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S
from conceptmill.operators.graph import REFS, Graph, edge_total, isolated, roots, styled
from conceptmill.operators.learner import with_mastery
from conceptmill.operators.text import note_sections

NODES = f"ord long, id string, name string, type string, domain string, desc string, difficulty int, aliases array<string>, evidence_refs {REFS}"
EDGES = f"ord long, source string, target string, type string, confidence double, note string, evidence_refs {REFS}"
EVIDENCE = "array<struct<type:string,desc:string,weight:double,ts:string,revoked:boolean>>"
STATES = f"user_id string, concept_id string, mastery double, confidence double, evidence {EVIDENCE}, last_touched string, source string"
#: Configuration-sized files may have this many bytes.
MAX_DRIVER_FILE = 256 << 20


def read_document(path: str) -> dict:
    """A JSON file by its suffix, anything else as YAML."""
    if os.path.getsize(path) > MAX_DRIVER_FILE:
        raise ValueError(f"{path} is over {MAX_DRIVER_FILE} bytes")
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def _refs(x: dict) -> list[dict]:
    blank = {"section": "", "chunk_sha256": "", "quote": "", "quote_verified": False}
    return [blank | r for r in x.get("evidence_refs") or []]


def _check_node(n: dict) -> dict:
    if not n.get("id") or not n.get("name") or n.get("type") not in S.NODE_TYPES or not 1 <= n.get("difficulty", 3) <= 5:
        raise ValueError(f"invalid node {n.get('id')!r}")
    return {"id": n["id"], "name": n["name"], "type": n["type"], "domain": n.get("domain", ""), "desc": n.get("desc", ""), "difficulty": n.get("difficulty", 3), "aliases": n.get("aliases") or [], "evidence_refs": _refs(n)}


def _check_edge(r: dict) -> dict:
    if not r.get("source") or not r.get("target") or r.get("type") not in S.RELATION_TYPES or not 0 <= r.get("confidence", 1.0) <= 1:
        raise ValueError(f"invalid relation {r.get('source')!r} -> {r.get('target')!r}")
    return {"source": r["source"], "target": r["target"], "type": r["type"], "confidence": float(r.get("confidence", 1.0)), "note": r.get("note", ""), "evidence_refs": _refs(r)}


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([r | {"ord": i} for i, r in enumerate(rows)], schema)


def read_layers(spark: SparkSession, *paths: str) -> Graph:
    """Stack ontology files: a node of a known id overrides the fields it supplies, an edge of a known
    key replaces the row; missing files are skipped, but one must exist; later checks are the build's."""
    found = [p for p in paths if os.path.exists(p)]
    if not found:
        raise FileNotFoundError(f"none of {paths}")
    nodes: dict[str, dict] = {}
    edges: dict[tuple, dict] = {}
    for layer in map(read_document, found):
        for n in layer.get("nodes") or []:
            if not n.get("id"):
                raise ValueError("a node without id")
            nodes[n["id"]] = nodes.get(n["id"], {}) | n
        for r in layer.get("relations") or []:
            edges[r.get("source"), r.get("target"), r.get("type")] = r
    return Graph.build(_frame(spark, [_check_node(n) for n in nodes.values()], NODES), _frame(spark, [_check_edge(r) for r in edges.values()], EDGES))


def read_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, source) of a payload, unvalidated."""
    data = read_document(path)
    nodes = [{"id": n.get("id"), "name": n.get("name"), "type": n.get("type", "Concept"), "domain": n.get("domain", ""), "desc": n.get("desc", ""), "difficulty": n.get("difficulty", 3), "aliases": n.get("aliases") or [], "evidence_refs": _refs(n)} for n in data.get("nodes") or []]
    edges = [{"source": r.get("source"), "target": r.get("target"), "type": r.get("type"), "confidence": float(r.get("confidence", 1.0)), "note": r.get("note", ""), "evidence_refs": _refs(r)} for r in data.get("relations") or []]
    return _frame(spark, nodes, NODES), _frame(spark, edges, EDGES), data.get("source", "")


def read_learner(spark: SparkSession, path: str) -> DataFrame:
    """One learner's states; a missing file is an empty learner; a state may name its own concept."""
    data = read_document(path) if os.path.exists(path) else {}
    rows = []
    for key, s in (data.get("states") or {}).items():
        ev = [{"type": e.get("type"), "desc": e.get("desc", ""), "weight": float(e.get("weight", 0.5)), "ts": e.get("ts"), "revoked": bool(e.get("revoked", False))} for e in s.get("evidence") or []]
        rows.append({"user_id": s.get("user_id", data.get("user_id", "me")), "concept_id": s.get("concept_id", key), "mastery": float(s.get("mastery", 0)), "confidence": float(s.get("confidence", 0.3)), "evidence": ev, "last_touched": s.get("last_touched"), "source": s.get("source", "")})
    return spark.createDataFrame(rows, STATES)


def write_learner(states: DataFrame, path: str, user_id: str = "me") -> None:
    """One learner's file, replaced as a whole."""
    out = {r["concept_id"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "user_id"} for r in states.filter(F.col("user_id") == user_id).toLocalIterator()}
    _replace(path, json.dumps({"user_id": user_id, "states": out}, ensure_ascii=False, indent=1))


def _replace(path: str, text: str) -> None:
    """Write beside the target, keep the old file as .bak, then rename."""
    new = Path(f"{path}.tmp")
    new.write_text(text, encoding="utf-8")
    if os.path.exists(path):
        Path(f"{path}.bak").write_bytes(Path(path).read_bytes())
    os.replace(new, path)


def write_patch(path: str, nodes: list[dict], relations: list[dict]) -> bool:
    """Overlay entries on a patch layer; nothing new leaves the file untouched."""
    if not nodes and not relations:
        return False
    old = read_document(path) if os.path.exists(path) else {}
    by_id = {n["id"]: n for n in old.get("nodes") or [] if n.get("id")}
    for n in nodes:
        by_id[n["id"]] = by_id.get(n["id"], {}) | n
    key = lambda r: (r["source"], r["target"], r["type"])
    by_key = {key(r): r for r in old.get("relations") or [] if {"source", "target", "type"} <= r.keys()} | {key(r): r for r in relations}
    import yaml

    _replace(path, yaml.safe_dump({"nodes": [*by_id.values()], "relations": [*by_key.values()]}, allow_unicode=True, sort_keys=False))
    return True


def write_sqlite(g: Graph, path: str) -> None:
    """Drop and create nodes and edges in a SQLite file; arrays as JSON text; rows stream through the driver."""
    with sqlite3.connect(path) as db:
        db.executescript("DROP TABLE IF EXISTS nodes; DROP TABLE IF EXISTS edges; CREATE TABLE nodes(id TEXT PRIMARY KEY, name TEXT, type TEXT, domain TEXT, desc TEXT, difficulty INT, aliases TEXT, evidence_refs TEXT); CREATE TABLE edges(source TEXT, target TEXT, type TEXT, confidence REAL, note TEXT, evidence_refs TEXT, PRIMARY KEY(source, target, type));")
        text = lambda df, c: F.coalesce(F.to_json(c), F.lit("[]")) if c in df.columns else F.lit("[]")
        n = g.nodes.orderBy("ord").select("id", "name", "type", "domain", "desc", "difficulty", text(g.nodes, "aliases"), text(g.nodes, "evidence_refs"))
        db.executemany("INSERT INTO nodes VALUES(?,?,?,?,?,?,?,?)", (tuple(r) for r in n.toLocalIterator()))
        e = g.edges.orderBy("ord").select("source", "target", "type", "confidence", "note", text(g.edges, "evidence_refs"))
        db.executemany("INSERT OR REPLACE INTO edges VALUES(?,?,?,?,?,?)", (tuple(r) for r in e.toLocalIterator()))


def read_sqlite(spark: SparkSession, path: str) -> Graph:
    """Back from SQLite; tables from before provenance have none."""
    with sqlite3.connect(path) as db:
        db.row_factory = sqlite3.Row
        get = lambda r, k: json.loads(r[k] or "[]") if k in r.keys() else []  # noqa: E731, SIM118
        nodes = [_check_node({**{k: r[k] for k in ("id", "name", "type", "domain", "desc", "difficulty")}, "aliases": get(r, "aliases"), "evidence_refs": get(r, "evidence_refs")}) for r in db.execute("SELECT * FROM nodes")]
        edges = [_check_edge({**{k: r[k] for k in ("source", "target", "type", "confidence", "note")}, "evidence_refs": get(r, "evidence_refs")}) for r in db.execute("SELECT * FROM edges")]
    return Graph.build(_frame(spark, nodes, NODES), _frame(spark, edges, EDGES))


def write_index(nodes: DataFrame, communities: DataFrame, signature: str, path: str) -> None:
    """Both indexes (id, ord, vector) under one manifest, written last."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    communities.write.mode("overwrite").parquet(f"{path}/communities")
    nodes.sparkSession.createDataFrame([(signature,)], "signature string").write.mode("overwrite").parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, signature: str) -> tuple[DataFrame, DataFrame] | None:
    """The indexes if the manifest has the expected signature, else None."""
    try:
        found = spark.read.parquet(f"{path}/manifest").first()
    except Exception:  # noqa: BLE001  a missing or half-written index is a stale one
        return None
    return (spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/communities")) if found and found["signature"] == signature else None


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    rows = read_document(path)
    rows = rows.get("queries", rows) if isinstance(rows, dict) else rows
    return spark.createDataFrame([(i, r["query"], r["golden"]) for i, r in enumerate(rows)], "qid int, query string, golden array<string>")


NOTE_KINDS = (".docx", ".md", ".markdown", ".txt")


def resolve_inputs(paths: list[str]) -> tuple[list[str], list[str]]:
    """(files, missing paths): folders give their notes, sorted, without dot-files; files stay as they are."""
    found, missing = [], []
    for path in paths:
        if os.path.isdir(path):
            found += sorted(str(f) for f in Path(path).rglob("*") if f.suffix.lower() in NOTE_KINDS and not f.name.startswith("."))
        elif os.path.isfile(path):
            found.append(path)
        else:
            missing.append(path)
    return found, missing


def write_staged(payload: dict, folder: str, stem: str) -> str:
    """A payload for review in the staging folder, which is made; the path written."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{stem}_triples.json")
    _replace(path, json.dumps(payload, ensure_ascii=False, indent=2))
    return path


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, title, breadcrumb, level, text, error) of every note under a path, dot-files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(F.col("path").rlike("(?i)\\.(docx|md|markdown|txt)$") & ~F.col("path").rlike("/\\.[^/]*$")).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(p, i, s.title, s.breadcrumb, s.level, s.text, None) for i, s in enumerate(note_sections(p, c))]
                except Exception as e:  # noqa: BLE001  one unreadable note must not end the scan
                    rows.append((p, -1, "", "", 0, "", str(e)))
            yield pd.DataFrame(rows, columns=["path", "seq", "title", "breadcrumb", "level", "text", "error"])

    return files.mapInPandas(run, "path string, seq int, title string, breadcrumb string, level int, text string, error string")


def web_payload(g: Graph, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the display, each row as JSON."""
    m = with_mastery(g.nodes, one).withColumn("band", S.band(F.col("mastery"))).withColumn("color", S.band_color(F.col("band")))
    cols = ["id", "name", "type", "domain", "desc", "difficulty", "mastery", "band", "color"]
    return m.orderBy("ord").select(F.to_json(F.struct(*cols)).alias("json")), styled(g.edges).select(F.to_json(F.struct("source", "target", "type", F.col("link_id").alias("id"), "color", "dash", "width")).alias("json"))


def web_meta(g: Graph, one: DataFrame) -> DataFrame:
    """One row of the display's figures: nodes, edges, domains, roots, isolated nodes, mean mastery over all nodes."""
    m = with_mastery(g.nodes, one).agg(F.count("*").alias("nodes"), F.countDistinct("domain").alias("domains"), F.coalesce(F.avg("mastery"), F.lit(0.0)).alias("mean_mastery"))
    m = m.join(F.broadcast(edge_total(g).withColumnRenamed("n", "edges")))
    for name, df in (("roots", roots(g)), ("isolated", isolated(g))):
        m = m.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return m.select("nodes", "edges", "domains", "roots", "isolated", F.round("mean_mastery", 6).alias("mean_mastery"))
