"""Extraction of payloads from chunks through a model client; one bad chunk never ends a batch."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S

from . import ingest as I
from .graph import REFS
from .suggest import candidates
from .text import LOCATION, parse_object

QUOTE_CHARS, KNOWN_ALIASES = 240, 3


def known_lines(nodes: DataFrame) -> list[str]:
    """Existing nodes for the prompt: id, name and first aliases, by id."""
    rows = nodes.orderBy("id").select("id", "name", F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, KNOWN_ALIASES).alias("a"))
    return [f"- {r['id']}: {r['name']}" + (f" ({', '.join(r['a'])})" if r["a"] else "") for r in rows.toLocalIterator()]


def build_prompt(chunk: str, known: list[str]) -> str:
    return (
        "Extract concepts and typed relations as one JSON object {\"nodes\": [...], \"relations\": [...]}.\n"
        f"Node types: {', '.join(S.NODE_TYPES)}. Relation types: {', '.join(S.RELATION_TYPES)}.\n"
        "Reuse the identifiers of existing nodes:\n" + "\n".join(known) + f"\n\nText:\n{chunk}"
    )


def extract_one(client, prompt: str, retries: int = 1, gleans: int = 0) -> dict:
    """One chunk's payload: unreadable replies are asked again with the error, gleaning adds unseen items."""
    asked = prompt
    for n in range(retries + 1):
        try:
            payload = parse_object(client.complete(asked))
            break
        except ValueError as e:
            if n == retries:
                raise
            asked = f"{prompt}\n\nThe last reply could not be read ({e}); answer with one JSON object only."
    payload = {"nodes": list(payload.get("nodes") or []), "relations": list(payload.get("relations") or [])}
    key = lambda r: (r.get("source"), r.get("target"), r.get("type"))
    for _ in range(gleans):
        try:
            more = parse_object(client.complete(f"{prompt}\n\nAlready found: {json.dumps(payload, ensure_ascii=False)}\nAnswer with what was missed, in the same form."))
        except ValueError:
            break
        ids, keys = {n.get("id") for n in payload["nodes"]}, {key(r) for r in payload["relations"]}
        payload["nodes"] += [n for n in more.get("nodes") or [] if n.get("id") and n["id"] not in ids]
        payload["relations"] += [r for r in more.get("relations") or [] if key(r) not in keys]
    return payload


def with_refs(payload: dict, chunk: str, document: str, index: int) -> dict:
    """Every item with one source reference; quotes stay only if the chunk contains them."""
    head = LOCATION.format("\0").split("\0")
    section = chunk.split("\n", 1)[0][len(head[0]) : -len(head[1])] if chunk.startswith(head[0]) else ""

    def tagged(item: dict) -> dict:
        quote = item.get("quote") or ""
        real = bool(quote) and quote in chunk
        ref = {"document": os.path.basename(document), "chunk_id": f"chunk-{index:04d}", "section": section, "chunk_sha256": hashlib.sha256(chunk.encode()).hexdigest(), "quote": quote[:QUOTE_CHARS] if real else "", "quote_verified": real}
        return {k: v for k, v in item.items() if k != "quote"} | {"evidence_refs": [ref]}

    return {k: [tagged(x) for x in payload[k]] for k in ("nodes", "relations")}


def extract(chunks: DataFrame, make_client: Callable[[], object], known: list[str], retries: int = 1, gleans: int = 0, max_chunks: int | None = None) -> DataFrame:
    """(document, chunk_id, payload JSON, error) for chunks(document, idx, chunk).

    The limit applies before any model is asked. A client is made per task; a chunk's failure
    becomes its row's error.
    """
    wanted = chunks if max_chunks is None else chunks.orderBy("document", "idx").limit(max_chunks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            rows = []
            for d, i, c in zip(frame["document"], frame["idx"], frame["chunk"], strict=True):
                try:
                    payload = with_refs(extract_one(client, build_prompt(c, known), retries, gleans), c, d, int(i))
                    rows.append((d, f"chunk-{int(i):04d}", json.dumps(payload, ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((d, f"chunk-{int(i):04d}", None, str(e)))
            yield pd.DataFrame(rows, columns=["document", "chunk_id", "payload", "error"])

    return wanted.select("document", "idx", "chunk").mapInPandas(run, "document string, chunk_id string, payload string, error string")


_NODE = "id string, name string, type string, domain string, desc string, difficulty int, aliases array<string>"
_EDGE = "source string, target string, type string, confidence double, note string"


def payloads(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extract's rows, merged over all chunks, with references; failed chunks give none.

    Chunks count in the order of document and chunk number; missing types, difficulties and
    confidences get the defaults of a payload.
    """
    schema = f"nodes array<struct<{_as_fields(_NODE)},evidence_refs:{REFS}>>, relations array<struct<{_as_fields(_EDGE)},evidence_refs:{REFS}>>"
    read = extracted.filter("payload is not null").select("document", "chunk_id", F.from_json("payload", schema).alias("p"))
    # An item's place is its document, chunk and position, as one sortable text.
    place = lambda c: F.concat_ws("/", "document", "chunk_id", F.lpad(F.col(c).cast("string"), 6, "0")).alias("ord")
    nodes = read.select("document", "chunk_id", F.posexplode("p.nodes").alias("at", "x")).select(place("at"), "x.*")
    nodes = nodes.withColumn("type", F.coalesce("type", F.lit("Concept"))).withColumn("difficulty", F.coalesce("difficulty", F.lit(3)))
    edges = read.select("document", "chunk_id", F.posexplode("p.relations").alias("at", "x")).select(place("at"), "x.*")
    edges = edges.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("note", F.coalesce("note", F.lit("")))
    return _numbered(I.merge_chunk_nodes(nodes).join(_refs(nodes, ["id"]), "id")), _numbered(_merged_edges(edges))


def _as_fields(ddl: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in ddl.split(", "))


def _refs(rows: DataFrame, key: list[str]) -> DataFrame:
    return I.with_refs(rows).groupBy(*key).agg(I.united_refs(I.gathered()).alias("evidence_refs"))


def _merged_edges(rows: DataFrame) -> DataFrame:
    """One edge per key regardless of case: the most confident row's values, the first on a tie, all references."""
    keyed = I.with_refs(rows).withColumns({"k_source": S.normalized(F.col("source")), "k_target": S.normalized(F.col("target"))})
    value = F.struct("source", "target", "confidence", "note")
    return keyed.groupBy("k_source", "k_target", "type").agg(F.min("ord").alias("place"), F.min_by(value, F.struct(-F.col("confidence"), "ord")).alias("b"), I.united_refs(I.gathered()).alias("evidence_refs")).select(F.col("place").alias("ord"), "b.source", "b.target", "type", "b.confidence", "b.note", "evidence_refs")


def _numbered(rows: DataFrame) -> DataFrame:
    """Text places as increasing numbers, over range partitions instead of one task."""
    return rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("ord", F.monotonically_increasing_id())


def prompt_nodes(g, candidates: DataFrame) -> DataFrame:
    """The nodes that a prompt about candidates names: those of the candidates' domains, so that it does not grow with the graph."""
    return g.nodes.join(candidates.select("domain").distinct(), "domain", "left_semi").select("id", "name", "domain")


def suggest(candidates: list[dict], client, max_edges: int = 10, known: set[str] | None = None) -> list[dict]:
    """Prerequisite edges a model proposes for candidates; a missing confidence is .6, the reason is the note.

    With ``known`` identifiers, edges that name others, and loops, are left out.
    """
    reply = parse_object(client.complete("Propose missing prerequisites as {\"edges\": [{\"source\", \"target\", \"confidence\", \"reason\"}]}.\n" + "\n".join(json.dumps(c, ensure_ascii=False) for c in candidates)))
    found = [e for e in reply.get("edges") or [] if isinstance(e, dict) and e.get("source") and e.get("target")]
    if known is not None:
        found = [e for e in found if {e["source"], e["target"]} <= known and e["source"] != e["target"]]
    return [{"source": e["source"], "target": e["target"], "type": e.get("type", "prerequisite_of"), "confidence": float(e.get("confidence", 0.6)), "note": e.get("reason", "")} for e in found[:max_edges]]


def suggest_prerequisites(g, client, limit: int = 12, max_edges: int = 10) -> tuple[dict, dict]:
    """(payload, figures): a model's edges for the candidates of the graph, ready for review and ingestion."""
    rows = candidates(g, limit)
    asked = [{**r.asDict(), "mentioned_ids": list(r["mentioned_ids"])} for r in rows.drop("ord").collect()]  # ``limit`` rows
    ids = {r["id"] for r in prompt_nodes(g, rows).select("id").collect()} | {i for a in asked for i in a["mentioned_ids"]}
    edges = suggest(asked, client, max_edges, ids)
    return {"source": "llm_prerequisite_suggestion", "nodes": [], "relations": edges}, {"candidates": len(asked), "suggested": len(edges)}


def _score(x) -> float:
    try:
        return min(1.0, max(0.0, float(x)))
    except (TypeError, ValueError):
        return 0.0


def judge_answer(client, question: str, context: str, golden: list[str]) -> dict:
    """Answer from the context, have it judged; scores are clamped, unreadable verdicts and empty contexts score 0.

    Coverage is the share of golden names that the answer contains; without golden names it is 1.
    """
    if not context:
        return {"answer": "", "faithfulness": 0.0, "relevancy": 0.0, "golden_coverage": 0.0}
    answer = client.complete(f"Answer from the context only.\n{context}\n\nQuestion: {question}")
    try:
        verdict = parse_object(client.complete(f"Judge as {{\"faithfulness\", \"relevancy\"}} from 0 to 1.\nContext: {context}\nQuestion: {question}\nAnswer: {answer}"))
    except ValueError:
        verdict = {}
    covered = sum(g in answer for g in golden) / len(golden) if golden else 1.0
    return {"answer": answer, "faithfulness": _score(verdict.get("faithfulness")), "relevancy": _score(verdict.get("relevancy")), "golden_coverage": round(covered, 3)}
