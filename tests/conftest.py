import pytest
from graph_helpers import P, make_edges, make_nodes
from pyspark.sql import SparkSession

from conceptmill.operators.graph import Graph


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def graph(spark):
    """a -> b -> d -> e, a -> c -> d, a -> e (a shortcut), f beside b, lone x."""
    nodes = make_nodes(spark, [("a", "Sets", 1, "math", ["set theory"]), ("b", "Maps", 2, "math", []), ("c", "Logic", 3, "math", []), ("d", "Graphs", 3, "cs", []), ("e", "Paths", 4, "cs", ["routes"]), ("f", "Mappings", 2, "math", []), ("x", "Tea", 1, "life", [])])
    edges = make_edges(spark, [("a", "b", P, 1.0), ("a", "c", P, 1.0), ("b", "d", P, 1.0), ("c", "d", P, 1.0), ("d", "e", P, 1.0), ("a", "e", P, 1.0), ("b", "f", "confusable_with", 0.5), ("b", "d", "related_to", 0.5)])
    return Graph.build(nodes, edges)


@pytest.fixture(scope="session")
def one(spark):
    return spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.4)], "concept_id string, mastery double")
