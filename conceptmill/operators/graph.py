"""Graph operators over node and edge tables.

nodes(ord, id, name, type, domain, desc, difficulty, aliases)
edges(ord, source, target, type, confidence, note)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmill.checkpoints import checkpointed as cut
from conceptmill.functions import scalar as S

from . import closure
from .cliques import Cliques

PREREQUISITE = "prerequisite_of"
#: Source references of nodes and edges.
REFS = "array<struct<document:string,chunk_id:string,section:string,chunk_sha256:string,quote:string,quote_verified:boolean>>"
#: Degree from which a label is shown.
LABEL_DEGREE = 5


@dataclass
class Graph:
    """Nodes, and edges that are listed or implied by cliques."""

    nodes: DataFrame
    listed: DataFrame
    cliques: Cliques | None = None

    @property
    def edges(self) -> DataFrame:
        """All edges; cliques are written out."""
        return self.listed if self.cliques is None else self.listed.unionByName(self.cliques.edges())

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame) -> Graph:
        """Later nodes of an id overwrite earlier ones but keep the first place; so do edges of a key.

        Raises ValueError if an edge names an unknown node.
        """
        n = latest(nodes, ["id"])
        e = latest(edges, ["source", "target", "type"])
        if bad := dangling(n, e).limit(3).collect():
            raise ValueError(f"edges with unknown endpoints: {[(r.source, r.target) for r in bad]}")
        return Graph(n, e)

    @property
    def prerequisites(self) -> DataFrame:
        return self.edges.filter(F.col("type") == PREREQUISITE)


def split(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(few, met): the listed edges with those clique edges that share a pair of ends with one of them, and the
    latter's (source, target). Every other clique edge is the only edge of its pair, see Cliques.rest."""
    met = g.cliques.met(g.listed)
    return g.listed.unionByName(g.cliques.rows(met)), met


def latest(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the last row's values at the first row's place."""
    rest = [c for c in df.columns if c not in (*key, "ord")]
    last = F.max_by(F.struct(*rest), "ord").alias("_last")
    return df.groupBy(*key).agg(F.min("ord").alias("ord"), last).select("ord", *key, "_last.*").select(df.columns)


def dangling(nodes: DataFrame, edges: DataFrame, cliques: Cliques | None = None) -> DataFrame:
    """Edges, listed or of cliques, that name an unknown node; each once."""
    ids = nodes.select(F.col("id").alias("_id"))
    if cliques is not None:
        m = cliques.members
        lost = m.join(ids, F.col("id") == F.col("_id"), "left_anti").select("clique", F.col("place").alias("_own"), F.col("id").alias("_lost"))
        ends = [F.when(F.col("_own") < F.col("place"), F.col(x)).otherwise(F.col(y)) for x, y in (("_lost", "id"), ("id", "_lost"))]
        edges = edges.unionByName(cliques.rows(lost.join(m, "clique").filter("place != _own").select(ends[0].alias("source"), ends[1].alias("target"))).select(edges.columns))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_anti").unionByName(edges.join(ids, F.col("target") == F.col("_id"), "left_anti")).distinct()


def node(g: Graph, node_id: str) -> DataFrame:
    """The node of an identifier; no row if there is none."""
    return g.nodes.filter(F.col("id") == node_id)


def find_shown(g: Graph, keyword: str) -> DataFrame:
    """The display's search: the first node whose lower-case name, or whose id as it is, contains the lower-case keyword."""
    k = keyword.strip().lower()
    return g.nodes.filter(F.lit(k != "") & (F.contains(F.lower("name"), F.lit(k)) | F.contains("id", F.lit(k)))).orderBy("ord").limit(1)


def shown_labels(g: Graph, least: int = LABEL_DEGREE) -> DataFrame:
    """(id, degree): nodes whose label is shown, those that so many edge ends touch."""
    ends = g.listed.select(F.col("source").alias("id")).union(g.listed.select("target"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    if g.cliques is not None:
        degree = degree.unionByName(g.cliques.degree()).groupBy("id").agg(F.sum("degree").alias("degree"))
    return degree.filter(F.col("degree") >= least)


def target_list(g: Graph) -> DataFrame:
    """(domain, place, id, name): the choice of targets, domains in order, names in order within each."""
    w = Window.partitionBy("domain").orderBy("name", "id")
    return g.nodes.select("domain", (F.row_number().over(w) - 1).alias("place"), "id", "name")


def find(g: Graph, keyword: str) -> DataFrame:
    return g.nodes.filter(S.mentions(keyword, F.col("id"), F.col("name"), F.col("aliases"))).orderBy("ord")


def resolve(g: Graph, keyword: str) -> DataFrame:
    """The first exact hit by id, name or alias, else the first hit; one row or none."""
    k = keyword.strip().lower()
    exact = F.exists(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda t: F.lower(t) == k)
    return find(g, keyword).orderBy(exact.desc(), "ord").limit(1)


def edges_of(g: Graph, node_id: str, rel_type: str | None = None) -> DataFrame:
    """Outgoing, then incoming edges; a loop appears twice."""
    e = g.edges if rel_type is None else g.edges.filter(F.col("type") == rel_type)
    return e.filter(F.col("source") == node_id).withColumn("dir", F.lit(0)).unionByName(e.filter(F.col("target") == node_id).withColumn("dir", F.lit(1)))


def around(g: Graph, ids: DataFrame) -> DataFrame:
    """(near, id, type): the other ends of the edges that touch given ids."""
    both = g.listed.select(F.col("source").alias("near"), F.col("target").alias("id"), "type").union(g.listed.select("target", "source", "type"))
    found = both.join(ids.select(F.col("id").alias("near")).distinct(), "near", "left_semi")
    return found if g.cliques is None else found.unionByName(g.cliques.around(ids).withColumn("type", F.lit(g.cliques.type)))


def dependents(g: Graph) -> DataFrame:
    return g.prerequisites.select(F.col("source").alias("id"), F.col("target").alias("dependent")).distinct()


def confusable(g: Graph) -> DataFrame:
    few, met = (g.edges, None) if g.cliques is None else split(g)
    e = few.filter(F.col("type") == "confusable_with")
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other")).union(e.select("target", "source")).distinct()
    if met is None or g.cliques.type != "confusable_with":
        return both
    return both.union(g.cliques.rest(met, both_ways=True).select("source", "target"))


def roots(g: Graph) -> DataFrame:
    """Nodes that something depends on and that depend on nothing."""
    p = g.prerequisites
    return p.select(F.col("source").alias("id")).distinct().join(p.select(F.col("target").alias("id")), "id", "left_anti")


def leaves(g: Graph) -> DataFrame:
    p = g.prerequisites
    return p.select(F.col("target").alias("id")).distinct().join(p.select(F.col("source").alias("id")), "id", "left_anti")


def isolated(g: Graph) -> DataFrame:
    touched = g.listed.select(F.col("source").alias("id")).union(g.listed.select("target"))
    if g.cliques is not None:
        touched = touched.union(g.cliques.degree().select("id"))
    touched = touched.distinct()
    return g.nodes.select("id").join(touched, "id", "left_anti")


def edge_counts(g: Graph) -> DataFrame:
    """(type, n): the edges by type."""
    counts = g.listed.groupBy("type").agg(F.count("*").alias("n"))
    if g.cliques is None:
        return counts
    implied = g.cliques.count().filter("n > 0").select(F.lit(g.cliques.type).alias("type"), "n")
    return counts.unionByName(implied).groupBy("type").agg(F.sum("n").alias("n"))


def edge_total(g: Graph) -> DataFrame:
    """One row (n): the number of edges."""
    return edge_counts(g).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def stats(g: Graph) -> DataFrame:
    """(kind, value, n): nodes by type and domain, edges by type, and the totals."""
    sides = [
        g.nodes.groupBy(F.lit("node_type").alias("kind"), F.col("type").alias("value")).agg(F.count("*").alias("n")),
        g.nodes.groupBy(F.lit("domain").alias("kind"), F.col("domain").alias("value")).agg(F.count("*").alias("n")),
        edge_counts(g).select(F.lit("edge_type").alias("kind"), F.col("type").alias("value"), "n"),
        edge_total(g).select(F.lit("total").alias("kind"), F.lit("edges").alias("value"), "n"),
        *[df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("value"), "n") for name, df in (("nodes", g.nodes), ("roots", roots(g)), ("isolated", isolated(g)))],
    ]
    return reduce(DataFrame.unionByName, sides)


def multi_relation_pairs(g: Graph) -> DataFrame:
    few = g.edges if g.cliques is None else split(g)[0]
    return few.groupBy("source", "target").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.countDistinct("type").alias("n")).filter("n > 1")


def ancestors(edges: DataFrame, targets: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(id, ancestor, hop): everything reachable against the edges, at its least number of hops.

    Without a depth, a graph of up to closure.HELD_EDGES edges is searched inside the tasks, target by
    target, and its pairs are not shuffled. Else it is a frontier loop: each round joins the newest
    pairs with the edges and drops pairs already seen; every round is checkpointed and broadcasts
    nothing by hand. In a cycle a node becomes its own ancestor and both end.
    """
    up = edges.select(F.col("target").alias("_child"), F.col("source").alias("_parent")).distinct()
    if depth is None:
        up = cut(up)
        size = up.agg(F.count("*").alias("n"), F.count_if(F.col("_child").isNull() | F.col("_parent").isNull()).alias("open")).first()
        # Pairs without an end are rare and only the loop carries them.
        if size["n"] <= closure.HELD_EDGES and not size["open"]:
            graph, codes = closure.held(up.select(F.col("_child").alias("child"), F.col("_parent").alias("parent")))
            return closure.closure(graph, codes, up.select(F.col("_child").alias("id")) if targets is None else targets)
    start = up.select(F.col("_child").alias("id"), F.col("_parent").alias("ancestor"))
    if targets is not None:
        start = start.join(targets.select("id").distinct(), "id", "left_semi")
    frontier = cut(start.withColumn("hop", F.lit(1)))
    seen = frontier
    hop = 1
    while (depth is None or hop < depth) and not frontier.isEmpty():
        hop += 1
        stepped = frontier.join(up, F.col("ancestor") == F.col("_child")).select("id", F.col("_parent").alias("ancestor")).distinct()
        frontier = cut(stepped.join(seen, ["id", "ancestor"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = cut(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)
    return seen


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after peeling off, round by round, those that start at a node without predecessors
    or end at one without successors; empty if and only if the graph has no cycle."""
    left = cut(edges.select("source", "target").distinct())
    size = left.count()
    while size:
        into, out = left.select(F.col("target").alias("source")).distinct(), left.select(F.col("source").alias("target")).distinct()
        left = cut(left.join(into, "source", "left_semi").join(out, "target", "left_semi").select("source", "target"))
        now = left.count()
        if now == size:
            break
        size = now
    return left


def is_acyclic(g: Graph) -> bool:
    return cyclic_core(g.prerequisites).isEmpty()


def cycles(g: Graph, limit: int = 3) -> list[list[str]]:
    """Up to ``limit`` cycles, those of the least nodes; none if and only if there is no cycle.

    Every node of the cyclic core points to its least successor there. By pointer doubling each
    learns where its walk ends up, and the least node on the way; ends are nodes of cycles, and
    nodes with one least node on the way are one cycle. Only the wanted cycles come to the driver.
    """
    core = cyclic_core(g.prerequisites)
    # Ends of the core without a successor inside it were peeled, so every node has one.
    step = cut(core.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("next")))
    nodes = step.count()
    if not nodes:
        return []
    jump = step.select("id", F.col("next").alias("end"), F.least("id", "next").alias("least"))
    width = 1
    while width < nodes:
        far = jump.select(F.col("id").alias("far"), F.col("end").alias("far_end"), F.col("least").alias("far_least"))
        jump = cut(jump.join(far, F.col("end") == F.col("far")).select("id", F.col("far_end").alias("end"), F.least("least", "far_least").alias("least")))
        width *= 2
    ends = jump.select(F.col("end").alias("on")).distinct()
    on = jump.join(ends, F.col("id") == F.col("on"), "left_semi").select("id", "least")
    wanted = on.select(F.col("least").alias("first")).distinct().orderBy("first").limit(limit)
    rows = on.join(wanted, F.col("least") == F.col("first"), "left_semi").join(step, "id").collect()
    follow = {r["id"]: r["next"] for r in rows}
    out = []
    for first in sorted({r["least"] for r in rows}):
        walk = [first]
        while follow[walk[-1]] != first:
            walk.append(follow[walk[-1]])
        out.append(walk)
    return out


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    ids = members.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): pairs regardless of direction and type, confidences summed."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("confidence").alias("weight"))


def undirected_pairs(g: Graph) -> DataFrame:
    """The same for all edges of a graph; a clique edge that is alone with its pair is not grouped."""
    if g.cliques is None:
        return undirected(g.edges)
    few, met = split(g)
    lone = g.cliques.rest(met).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit(g.cliques.confidence).alias("weight"))
    return undirected(few).unionByName(lone)


def degree_centrality(pairs: DataFrame, nodes: DataFrame, cliques: Cliques | None = None) -> DataFrame:
    """Simple undirected degree over n - 1; 1 for a single node. The pairs of cliques count too, each pair once."""
    if cliques is not None:
        a, b = (cliques.members.select(F.col("id").alias(x), F.col("clique").alias(f"c{x}")) for x in "ab")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").filter("ca is null or cb is null or ca != cb")
    ends = pairs.filter("a != b").select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.filter("a != b").select("b", "a")).distinct()
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    if cliques is not None:
        degree = degree.unionByName(cliques.degree()).groupBy("id").agg(F.sum("degree").alias("degree"))
    total = nodes.agg(F.count("*").alias("n"))
    d = F.coalesce("degree", F.lit(0))
    return nodes.select("id").join(degree, "id", "left").join(F.broadcast(total)).select("id", d.alias("degree"), F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(d / (F.col("n") - 1)).alias("centrality"))


def parallel_edges(g: Graph) -> DataFrame:
    """Each edge's index among its pair's edges, and the pair's number of edges."""
    w = Window.partitionBy("source", "target")
    few, met = (g.edges, None) if g.cliques is None else split(g)
    numbered = few.select("source", "target", "type", (F.row_number().over(w.orderBy("type")) - 1).alias("idx"), F.count("*").over(w).alias("n"))
    if met is None:
        return numbered
    return numbered.unionByName(g.cliques.rest(met).select("source", "target", F.lit(g.cliques.type).alias("type"), F.lit(0).alias("idx"), F.lit(1).cast("long").alias("n")))


def styled(edges: DataFrame) -> DataFrame:
    """Edges with their display style; unknown types look like related_to."""
    style: Column = F.create_map(*[x for k, (c, d, w) in S.RELATION_STYLES.items() for x in (F.lit(k), F.struct(F.lit(c).alias("color"), F.lit(d).alias("dash"), F.lit(w).alias("width")))])
    return edges.withColumn("_s", F.coalesce(style[F.col("type")], style[F.lit("related_to")])).select("source", "target", "type", F.concat_ws("__", "source", "target", "type").alias("link_id"), "_s.*")


def facets(g: Graph, domains: list[str], types: list[str]) -> DataFrame:
    """Edges whose type is chosen and whose ends are both in chosen domains."""
    ids = g.nodes.filter(F.col("domain").isin(domains)).select("id")
    return induced(g.edges.filter(F.col("type").isin(types)), ids)
