"""Retrieval and answers over an evaluation set: both modes searched, measured and judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmill.operators import extract as E
from conceptmill.operators import graph as G
from conceptmill.operators import retrieval as R
from conceptmill.operators import vectors as V
from conceptmill.operators.embedders import HashEmbedder
from conceptmill.operators.learner import with_mastery

# Context size of the plain mode, and of the graph mode when both are compared.
NAIVE_K, COMPARE_CONTEXT = 6, 6
MODES = ("naive", "graph")


def contexts(g: G.Graph, index: DataFrame, one: DataFrame, queries: list[tuple[int, str]], embedder=None, names: DataFrame | None = None, max_context: int = COMPARE_CONTEXT) -> DataFrame:
    """(mode, qid, id, place) of every query of an evaluation set by the nearest entries and by graph search."""
    embedder = embedder or HashEmbedder()
    parts = []
    for qid, text in queries:
        near = V.topk(index, V.query_column(embedder.queries([text])[0]), NAIVE_K).join(g.nodes.select("id"), "id", "left_semi")
        parts.append(near.select(F.lit("naive").alias("mode"), F.lit(qid).alias("qid"), "id", "ord"))
        found = R.search(g, index, text, one, embedder=embedder, names=names, max_context=max_context)
        parts.append(found.select(F.lit("graph").alias("mode"), F.lit(qid).alias("qid"), "id", F.col("place").alias("ord")))
    return reduce(DataFrame.unionByName, parts)


def evaluate(g: G.Graph, index: DataFrame, one: DataFrame, queries: list[tuple[int, str, list[str]]], client, embedder=None, names: DataFrame | None = None) -> tuple[dict, list[dict]]:
    """(means, rows) of judged answers: per query and mode faithfulness, relevancy and coverage of the golden names.

    An evaluation set is asked query by query, as the model is; an empty context scores 0, a query
    without golden nodes is covered.
    """
    embedder = embedder or HashEmbedder()
    called = {r["id"]: r["name"] for r in g.nodes.filter(F.col("id").isin(sorted({i for *_, golden in queries for i in golden}))).select("id", "name").collect()}
    rows = []
    for qid, text, golden in queries:
        near = V.topk(index, V.query_column(embedder.queries([text])[0]), NAIVE_K)
        named = with_mastery(near.join(g.nodes.select("id", "name", "desc"), "id"), one).withColumn("role", F.lit("naive")).withColumn("place", F.col("ord")).withColumn("band", R.S.band(F.col("mastery")))
        row: dict = {"qid": qid, "query": text}
        for mode, found in zip(MODES, (named, R.search(g, index, text, one, embedder=embedder, names=names)), strict=True):
            context = R.rendered(found).first()["context_text"]
            judged = E.judge_answer(client, text, context, [called[i] for i in golden if i in called])
            row |= {f"{mode}_{k}": v for k, v in judged.items()}
        rows.append(row)
    measures = [f"{mode}_{k}" for mode in MODES for k in ("faithfulness", "relevancy", "golden_coverage")]
    return {"queries": len(rows), **{m: round(sum(r[m] for r in rows) / max(len(rows), 1), 3) for m in measures}}, rows
