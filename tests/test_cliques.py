"""Graphs whose edges are implied by cliques, against the same graphs with every edge listed."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from graph_helpers import P, make_edges, make_nodes

from conceptmill.operators import graph as G
from conceptmill.operators.cliques import Cliques
from conceptmill.plans import catalog

SF = "/root/testdata/sf0.001"
MEMBERS = "clique string, place long, id string"


@pytest.fixture(scope="module")
def pair(spark):
    """(with cliques, written out): cliques of five, four (one unknown as a node) and one; listed edges along, against and beside them."""
    names = [f"a{k}" for k in range(1, 6)] + ["b1", "b2", "b3", "c1", "x", "z"]
    nodes = make_nodes(spark, [(n, f"N {n}", 1, n[0] if n[0] != "b" else "a", []) for n in names])
    rows = [("A", k, f"a{k}") for k in range(1, 6)] + [("B", k, n) for k, n in enumerate(("b3", "b1", "ghost", "b2"))] + [("C", 1, "c1")]
    listed = make_edges(spark, [("a1", "a2", P, 1.0), ("a4", "a3", P, 1.0), ("a1", "b1", P, 1.0), ("a1", "a2", "related_to", 0.25), ("b2", "x", "confusable_with", 0.5), ("x", "x", "related_to", 0.25), ("a2", "a1", "confusable_with", 0.5)])
    short = G.Graph(nodes, listed, Cliques(spark.createDataFrame(rows, MEMBERS), "confusable_with", 0.5))
    links = [(rows[i][2], rows[j][2]) for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] == rows[j][0] and rows[i][1] < rows[j][1]]
    return short, G.Graph(nodes, listed.unionByName(make_edges(spark, [(a, b, "confusable_with", 0.5) for a, b in links])))


@pytest.fixture(scope="module")
def vast(spark):
    """A clique of 300,000 members: 45 billion edges."""
    members = spark.range(300_000).selectExpr("'q' as clique", "id as place", "cast(id as string) as id")
    nodes = members.selectExpr("place as ord", "id", "id as name", "'Concept' as type", "'d' as domain", "'' as desc", "1 as difficulty", "array() as aliases")
    return G.Graph(nodes, make_edges(spark, [("1", "2", P, 1.0), ("5", "none", P, 1.0)]), Cliques(members, "confusable_with", 0.5))


def same(found, wanted):
    cols = wanted.columns
    got, want = (sorted(map(tuple, df.select(cols).collect()), key=repr) for df in (found, wanted))
    assert got == want and got


def test_edges_written_out(pair):
    short, full = pair
    same(short.edges.select("source", "target", "type", "confidence"), full.edges.select("source", "target", "type", "confidence"))


def test_large_clique_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("conceptmill.operators.cliques.BLOCK", 7)
    members = spark.range(100).selectExpr("if(id < 90, 'q', 'r') as clique", "id as place", "cast(id as string) as id")
    got = sorted((int(r.source), int(r.target)) for r in Cliques(members, "t", 1.0).edges().collect())
    assert got == sorted((a, b) for a in range(100) for b in range(a + 1, 100) if (a < 90) == (b < 90))


def test_confusable(pair):
    """F6."""
    same(G.confusable(pair[0]), G.confusable(pair[1]))


@pytest.mark.parametrize("name", ["confusable_pairs", "shown_labels", "degree_centrality", "undirected_weights", "isolated"])
def test_parts_without_brand_and_with_a_shared_key(spark, tmp_path, name):
    """F6 and its kin: such parts are no members, their edges are listed."""
    keys = [0, 1, 2, 3, 4, 4, 5, 6, None]
    part = {"p_partkey": pa.array(keys, pa.int64()), "p_name": ["n"] * 9, "p_brand": ["b", "b", "b", None, "b", "c", "c", "c", "b"], "p_type": ["t"] * 9, "p_size": pa.array([1] * 9, pa.int32())}
    pq.write_table(pa.table(part), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL[name]).fetchall() if name != "isolated" else [(str(k),) for k in ()]
    cols = [d[0] for d in con.description] if name != "isolated" else ["id"]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).filter("id is not null" if "id" in cols else "true").select(cols).collect()]
    plain = lambda rows: sorted((tuple(float(x) if not isinstance(x, str) else x for x in r) for r in rows if None not in r), key=repr)
    assert plain(got) == plain(wanted)


def test_community_hubs(spark, pair, one):
    """F5."""
    from conceptmill.operators import communities as C

    cols = ["community", "size", "hubs", "band", "untouched"]
    members = pair[0].nodes.select("id", "domain").withColumnRenamed("domain", "community")
    same(*(C.summarize(g, members, one).select(cols) for g in pair))


def test_community_of_a_vast_clique(spark, vast, one):
    """hubs are counted without the pairs."""
    from conceptmill.operators import communities as C

    row = C.summarize(vast, vast.nodes.select("id", "domain").withColumnRenamed("domain", "community"), one).select("size", "hubs").first()
    assert row.size == 300_000 and row.hubs == ["0", "1", "10", "100", "1000"]


def test_degree_centrality(pair):
    """F7."""
    short, full = pair
    same(G.degree_centrality(G.undirected(short.listed), short.nodes, short.cliques), G.degree_centrality(G.undirected(full.edges), full.nodes))


def test_degree_in_a_vast_clique(vast):
    """a neighbour that is listed and in the clique counts once."""
    c = G.degree_centrality(G.undirected(vast.listed), vast.nodes, vast.cliques).filter("id in ('1', '5', '7')")
    assert {r.id: r.degree for r in c.collect()} == {"1": 299_999, "5": 300_000, "7": 299_999}


def test_upsert_of_cliques(spark, pair):
    """F8."""
    from pyspark.sql import functions as F

    from conceptmill.operators import ingest as I

    short, full = pair
    odd = F.substring("target", 2, 1).isin("1", "3")
    cols = ["source", "target", "type", "confidence", "note", "change"]
    listed = short.listed.filter(odd).withColumn("confidence", F.lit(0.75))
    new = full.edges.filter(odd).withColumn("confidence", F.lit(0.75))
    # Two listed edges between the clique's ends, one of them with a clique edge's whole key.
    for extra in ([], [("a1", "a3", "confusable_with", 0.9), ("a2", "a5", P, 0.1)]):
        more = make_edges(spark, extra)
        got = I.upsert_graph(short, listed.unionByName(more), F.substring("id", 2, 1).isin("1", "3"), 0.75)
        same(got.select(cols), I.upsert_edges(full.edges, new.unionByName(more)).select(cols))


def test_multi_relation_pairs(pair, vast):
    """only listed pairs can have a second relation, so the rest is never made."""
    same(*map(G.multi_relation_pairs, pair))
    assert [(r.source, r.target, r.n) for r in G.multi_relation_pairs(vast).collect()] == [("1", "2", 2)]


def test_styled_cliques(spark, pair):
    """no pair of a clique goes through a shuffle or a broadcast; below the join are members only."""
    short, full = pair
    same(G.styled(short.listed).unionByName(G.styled(short.cliques.edges())), G.styled(full.edges))
    plan = catalog.style_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("ShuffledHashJoin")[0]
    assert "ShuffledHashJoin" in plan and "partitioning(link_id" not in above


def test_undirected_pairs(pair):
    """clique edges that meet a listed pair, along or against it, are summed with it."""
    same(G.undirected_pairs(pair[0]), G.undirected(pair[1].edges))


def test_parallel_edges(pair):
    """F16."""
    same(*map(G.parallel_edges, pair))


def test_stats(pair, vast):
    """edges are counted by the cliques' sizes."""
    same(*map(G.stats, pair))
    assert G.edge_total(vast).first().n == 300_000 * 299_999 // 2 + 2


def test_web_meta(pair, vast, one):
    """F15."""
    from conceptmill.sources import files

    same(*(files.web_meta(g, one) for g in pair))
    assert files.web_meta(vast, one).first().edges == 300_000 * 299_999 // 2 + 2


def test_isolated(pair, vast):
    """members of a clique are touched, unless they are alone in it."""
    same(*map(G.isolated, pair))
    assert G.isolated(vast).count() == 0


def test_shown_labels(pair, vast):
    """F21."""
    same(*(G.shown_labels(g, 3) for g in pair))
    assert {r.id: r.degree for r in G.shown_labels(vast).filter("degree > 299999").collect()} == {"1": 300_000, "2": 300_000, "5": 300_000}


def test_dangling(pair, vast):
    """a member that is no node makes each of its edges dangle."""
    short, full = pair
    cols = ["source", "target", "type"]
    same(G.dangling(short.nodes, short.listed, short.cliques).select(cols), G.dangling(full.nodes, full.edges).select(cols).distinct())
    assert [r.target for r in G.dangling(vast.nodes, vast.listed, vast.cliques).collect()] == ["none"]


def test_around(spark, pair):
    """neighbours of the seeds come from their own cliques."""
    from conceptmill.operators import retrieval as R

    seed = spark.createDataFrame([("a1", 0), ("b2", 1), ("x", 2)], "id string, seed_rank int")
    one = spark.createDataFrame([("a3", 0.4)], "concept_id string, mastery double")
    same(*(R.fill_expansion(g, seed, seed.select("id"), one) for g in pair))
    same(*(G.around(g, seed).distinct() for g in pair))


def test_batch_contexts(spark, pair):
    """F22."""
    from conceptmill.operators import retrieval as R

    one = spark.createDataFrame([("a3", 0.4)], "concept_id string, mastery double")
    index = pair[0].nodes.selectExpr("id", "ord", "array(cast(1 as double), cast(ord as double)) as vector")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, -0.3])], "qid long, qvec array<double>")
    same(*(R.batch_contexts(g, index, queries, one) for g in pair))


def test_merge_payload_of_cliques(spark, pair):
    """the nodes come without the edges; a new edge that has a clique edge's key updates it, the others are not stored."""
    from conceptmill.operators import ingest as I

    short, full = pair
    new = make_nodes(spark, [("", "Fresh", 2, "d", ["f"]), ("", "N a1", 1, "", ["one"])])
    edges = make_edges(spark, [("N a2", "a4", "confusable_with", 0.9), ("a5", "a1", "related_to", 0.3), ("Fresh", "a3", "part_of", 0.5), ("a2", "a3", P, 0.5)])
    found = I.merge_payload(short.nodes, short.listed, new, edges, "doc", cliques=short.cliques)
    wanted = I.merge_payload(full.nodes, full.edges, new, edges, "doc")
    cols = ["source", "target", "type", "confidence", "note", "evidence_refs"]
    same(found[1].select(cols), wanted[1].select(cols))
    same(found[2].select("kind", "item", "reason"), wanted[2].select("kind", "item", "reason"))
    cols = ["id", "name", "type", "domain", "aliases", "evidence_refs"]
    same(I.merge_nodes(short.nodes, new, "doc").select(cols), wanted[0].select(cols))
