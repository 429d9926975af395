"""Rows of small graphs for the tests; not in conftest, whose name the llm tests use too."""

NODES = "ord long, id string, name string, type string, domain string, desc string, difficulty int, aliases array<string>"
EDGES = "ord long, source string, target string, type string, confidence double, note string"
P = "prerequisite_of"


def make_nodes(spark, rows):
    """rows: (id, name, difficulty, domain, aliases)."""
    return spark.createDataFrame([(i, r[0], r[1], "Concept", r[3], f"about {r[1]}", r[2], r[4]) for i, r in enumerate(rows)], NODES)


def make_edges(spark, rows):
    """rows: (source, target, type, confidence)."""
    return spark.createDataFrame([(i, *r, "") for i, r in enumerate(rows)], EDGES)
