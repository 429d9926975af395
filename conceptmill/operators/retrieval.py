"""Retrieval: seeds, prerequisite and neighbour expansion, context assembly, comparison metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptmill.functions import scalar as S

from . import vectors as V
from .graph import Graph, ancestors, around, cut
from .embedders import HashEmbedder
from .learner import with_mastery
from .text import parse_object

# Defaults and the order of roles.
TOP_K, MAX_CONTEXT, PREREQ_DEPTH, MASTERY_WEIGHT, MAX_KEYWORDS = 3, 12, 1, 0.85, 6
ROLE_ORDER = {"seed": 0, "prerequisite": 1, "confusable": 2, "neighbor": 3}


def seeds(hits: DataFrame, nodes: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The first hits that still are nodes, in retrieval order."""
    live = hits.join(nodes.select("id"), "id", "left_semi")
    return _numbered(live, ["rank", "id"], top_k).withColumnRenamed("place", "seed_rank")


def _numbered(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """Rows with their place in an order, as far as the limit goes. A limit is a top-k of every task and
    one merge, so only its rows are numbered in one task; without one all rows are."""
    kept = df if limit is None else df.orderBy(*order).limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def prereq_expansion(g: Graph, seed: DataFrame, one: DataFrame, depth: int = PREREQ_DEPTH, limit: int | None = None) -> DataFrame:
    """Prerequisites of the seeds: by seed, then weakest, then easiest; each once, seeds themselves left out."""
    up = ancestors(g.prerequisites, seed.select("id"), depth).join(seed.select("id", "seed_rank"), "id").select(F.col("ancestor").alias("id"), "seed_rank")
    info = with_mastery(up.join(seed.select("id"), "id", "left_anti").join(g.nodes.select("id", "difficulty"), "id"), one)
    once = info.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seed_rank"))).filter("n = 1").drop("n")
    return _numbered(once, ["seed_rank", "mastery", "difficulty", "id"], limit)


def fill_expansion(g: Graph, seed: DataFrame, taken: DataFrame, one: DataFrame, limit: int | None = None) -> DataFrame:
    """Neighbours of the seeds by any edge, without what is taken: weakest first, then seed as text, then id."""
    near = around(g, seed).join(seed.select(F.col("id").alias("near"), "seed_rank"), "near")
    confusable = F.max(F.when(F.col("type") == "confusable_with", 1).otherwise(0)).alias("confusable")
    found = near.groupBy("id").agg(F.min(F.col("seed_rank").cast("string")).alias("seed_text"), confusable)
    free = found.join(taken.select("id"), "id", "left_anti")
    info = with_mastery(free.join(g.nodes.select("id", "name"), "id"), one)
    return _numbered(info, ["mastery", "seed_text", "id"], limit)


def assemble(seed: DataFrame, prereq: DataFrame, fill: DataFrame, max_context: int = MAX_CONTEXT) -> DataFrame:
    """(id, role, place): all seeds, then prerequisites and fill as far as the budget goes."""
    a = seed.select("id", F.lit("seed").alias("role"), F.lit(0).alias("tier"), F.col("seed_rank").alias("place"))
    b = prereq.select("id", F.lit("prerequisite").alias("role"), F.lit(1).alias("tier"), "place")
    c = fill.join(prereq.select("id"), "id", "left_anti").select("id", F.when(F.col("confusable") == 1, "confusable").otherwise("neighbor").alias("role"), F.lit(2).alias("tier"), "place")
    # Prerequisites and fill come cut to the budget, or the first of them are taken here.
    room = [x.orderBy("place", "id").limit(max_context) for x in (b, c)]
    ranked = _numbered(a.unionByName(room[0]).unionByName(room[1]).withColumnRenamed("place", "inner"), ["tier", "inner", "id"], None).drop("inner")
    return ranked.filter((F.col("tier") == 0) | (F.col("place") < max_context)).drop("tier")


def reranked(fill: DataFrame, nodes: DataFrame, client, query: str) -> DataFrame:
    """The fill in the order that a model puts its ids in, unknown ones last; any failure keeps the order."""
    rows = fill.join(nodes.select("id", "desc"), "id").orderBy("place").select("id", "name", "desc").collect()  # a context's worth
    try:
        asked = "\n".join(f"- {r['id']}: {r['name']} {r['desc'] or ''}" for r in rows)
        order = json.loads(client.complete(f"Question: {query}\nConcepts:\n{asked}\nAnswer with a JSON array of their ids, the most helpful first.").strip().strip("`").removeprefix("json"))
        wanted = F.array(*[F.lit(str(x)) for x in order]).cast("array<string>")
    except Exception:  # noqa: BLE001  a rerank adds, it must not break the search
        return fill
    at = F.array_position(wanted, F.col("id"))
    return _numbered(fill.withColumn("at", F.when(at == 0, F.lit(len(order) + 1)).otherwise(at)).withColumnRenamed("place", "before"), ["at", "before"], None).drop("at", "before")


def local_search(g: Graph, hits: DataFrame, one: DataFrame, top_k: int = TOP_K, max_context: int = MAX_CONTEXT, depth: int = PREREQ_DEPTH, rerank=None, query: str = "") -> DataFrame:
    """The context nodes for ranked hits (id, rank, sim), with role, mastery, band and similarity.

    ``rerank`` is a client that may put the fill in another order.
    """
    seed = seeds(hits, g.nodes, top_k)
    budget = top_k + max_context
    prereq = prereq_expansion(g, seed, one, depth, budget)
    fill = fill_expansion(g, seed, seed.select("id"), one, 2 * budget)
    context = assemble(seed, prereq, reranked(fill, g.nodes, rerank, query) if rerank else fill, max_context)
    named = with_mastery(context.join(g.nodes.select("id", "name", "domain", "desc", "difficulty"), "id"), one)
    full = named.join(seed.select("id", "sim"), "id", "left")
    m = F.round("mastery", 3)
    weighted = F.round(F.col("sim") * (1 - MASTERY_WEIGHT * F.col("mastery")), 4)
    return full.select("place", "id", "name", "role", "domain", "desc", "difficulty", m.alias("mastery"), S.band(F.col("mastery")).alias("band"), F.round(F.coalesce("sim", F.lit(0.0)), 4).alias("sim"), weighted.alias("weighted"))


def query_keywords(client, query: str, cap: int = MAX_KEYWORDS) -> list[str]:
    """Up to ``cap`` keywords that a model draws from a query; none on any failure."""
    try:
        found = parse_object(client.complete(f"Give at most {cap} search keywords, narrow and broad ones, as {{\"keywords\": [...]}}.\nQuestion: {query}")).get("keywords", [])
        return [k for k in (str(x).strip() for x in found) if k][:cap]
    except Exception:  # noqa: BLE001  keywords add, they must not break the search
        return []


def query_list(query: str, extra: list[str] | None) -> list[str]:
    """The query, then the others that are neither empty nor the query itself."""
    return [query, *(e for e in extra or [] if e and e != query)]


def search(g: Graph, index: DataFrame, query: str, one: DataFrame, extra: list[str] | None = None, pseudo_feedback: bool = True, embedder=None, names: DataFrame | None = None, **kw) -> DataFrame:
    """Local search for a text over an index (id, ord, vector); feedback uses the vectors of names (id, vector), or the hits' own."""
    vectors = (embedder or HashEmbedder()).queries(query_list(query, extra))
    queries = [V.query_column(v) for v in vectors]
    k = 4 * kw.get("top_k", TOP_K)
    hits = V.feedback(index, queries, k, names=names) if pseudo_feedback else V.max_pool(index, queries, k).withColumn("pin", F.lit(1))
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy("pin", F.desc("sim"), "ord")))
    return local_search(g, ranked, one, query=query, **kw)


def rendered(context: DataFrame) -> DataFrame:
    """One row (context_text): roles in order, a line for each node."""
    order = F.create_map(*[F.lit(x) for pair in ROLE_ORDER.items() for x in pair])
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "band", F.lit(", mastery "), F.format_number("mastery", 2), F.lit(")"), F.when(F.length("desc") > 0, F.concat(F.lit(": "), "desc")).otherwise(""))
    by_role = context.groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place"), line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    parts = by_role.select(F.struct(order[F.col("role")].alias("o"), F.concat(F.lit("["), "role", F.lit("]\n"), "lines").alias("t")).alias("s"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("context_text"))


def global_search(index: DataFrame, communities: DataFrame, query: str, top_k: int = 2, embedder=None) -> DataFrame:
    """Members of the communities whose summaries are closest, not deduplicated, role community:<id>."""
    hits = V.topk(index, V.query_column((embedder or HashEmbedder()).queries([query])[0]), top_k)
    found = hits.join(communities, "id").select("id", "sim", F.posexplode("members").alias("place", "member"), F.col("hubs"))
    return found.select(F.col("member").alias("id"), F.concat(F.lit("community:"), "id").alias("role"), "place", F.round("sim", 4).alias("sim"), F.array_contains("hubs", F.col("member")).alias("hub"))


def batch_contexts(g: Graph, index: DataFrame, queries: DataFrame, one: DataFrame, naive_k: int = 6, top_k: int = TOP_K, max_context: int = 6) -> DataFrame:
    """(mode, qid, id) for many queries (qid, qvec) at once: the nearest entries, and seeds with their expansions.

    The same rules as local_search without feedback, as joins and windows per query.
    """
    near = cut(V.topk_join(index, queries, max(naive_k, top_k)).join(g.nodes.select("id"), "id", "left_semi"))
    naive = near.filter(F.col("rank") <= naive_k).select(F.lit("naive").alias("mode"), "qid", "id")
    seed = near.withColumn("seed_rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1).filter(F.col("seed_rank") < top_k).select("qid", "id", "seed_rank")
    mine = seed.select("qid", "id")
    up = g.prerequisites.select("source", F.col("target").alias("id")).distinct().join(seed, "id").groupBy("qid", F.col("source").alias("id")).agg(F.min("seed_rank").alias("seed_rank"))
    up = with_mastery(up.join(mine, ["qid", "id"], "left_anti").join(g.nodes.select("id", "difficulty"), "id"), one)
    order = Window.partitionBy("qid")
    first = up.withColumn("inner", F.row_number().over(order.orderBy("seed_rank", "mastery", "difficulty", "id"))).select("qid", "id", F.lit(1).alias("tier"), "inner")
    both = around(g, seed).select(F.col("near").alias("id"), F.col("id").alias("other"))
    fill = both.join(seed, "id").groupBy("qid", F.col("other").alias("id")).agg(F.min(F.col("seed_rank").cast("string")).alias("seed_text"))
    fill = with_mastery(fill.join(mine, ["qid", "id"], "left_anti").join(first.select("qid", "id"), ["qid", "id"], "left_anti").join(g.nodes.select("id"), "id"), one)
    rest = fill.withColumn("inner", F.row_number().over(order.orderBy("mastery", "seed_text", "id"))).select("qid", "id", F.lit(2).alias("tier"), "inner")
    ranked = seed.select("qid", "id", F.lit(0).alias("tier"), F.col("seed_rank").alias("inner")).unionByName(first).unionByName(rest)
    ranked = ranked.withColumn("place", F.row_number().over(order.orderBy("tier", "inner", "id")))
    return naive.unionByName(ranked.filter((F.col("tier") == 0) | (F.col("place") <= max_context)).select(F.lit("graph").alias("mode"), "qid", "id"))


def compare(contexts: DataFrame, golden: DataFrame, edges: DataFrame, one: DataFrame) -> DataFrame:
    """Per mode: hit rate, 2-hop prerequisite coverage, mastered share and mean size.

    contexts(mode, qid, id), golden(qid, id); a query whose golden nodes need nothing is covered.
    """
    needs = golden.join(ancestors(edges, golden.select("id"), 2), "id").select("qid", F.col("ancestor").alias("id")).distinct()
    modes = contexts.select("mode", "qid").distinct()
    hit = contexts.join(golden, ["qid", "id"], "left_semi").select("mode", "qid").distinct().withColumn("hit", F.lit(1))
    want = needs.groupBy("qid").agg(F.count("*").alias("want"))
    got = contexts.join(needs, ["qid", "id"], "left_semi").groupBy("mode", "qid").agg(F.countDistinct("id").alias("got"))
    m = one.select(F.col("concept_id").alias("id"), "mastery")
    size = contexts.join(m, "id", "left").groupBy("mode", "qid").agg(F.count("*").alias("size"), F.avg(F.when(F.coalesce("mastery", F.lit(0.0)) >= S.MASTERED_FROM, 1.0).otherwise(0.0)).alias("mastered"))
    each = modes.join(hit, ["mode", "qid"], "left").join(want, "qid", "left").join(got, ["mode", "qid"], "left").join(size, ["mode", "qid"])
    cover = F.when(F.col("want").isNull(), 1.0).otherwise(F.coalesce("got", F.lit(0)) / F.col("want"))
    return each.groupBy("mode").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("golden_hit"), F.round(F.avg(cover), 3).alias("coverage"), F.round(F.avg("mastered"), 3).alias("mastered_ratio"), F.round(F.avg("size"), 1).alias("mean_size"))
