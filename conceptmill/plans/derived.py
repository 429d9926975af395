"""Graph, evidence and corpus views over the star-schema tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptmill.functions.scalar import NODE_TYPES
from conceptmill.operators.cliques import Cliques
from conceptmill.operators.graph import Graph
from conceptmill.operators.learner import mastery_from_log

AS_OF = "2024-01-31"
LEARNER = 7

SQL = {
    "nodes": f"""nodes AS (SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_partkey AS name,
        list_extract({NODE_TYPES!r}, CAST(p_partkey % 7 + 1 AS BIGINT)) AS type, p_brand AS domain, p_type || ' size ' || p_size AS descr,
        1 + p_size % 5 AS difficulty, p_type AS alias FROM part)""",
    "prereq": """prereq AS (SELECT CAST(p_partkey // 2 AS VARCHAR) AS source, CAST(p_partkey AS VARCHAR) AS target FROM part WHERE p_partkey > 1
        UNION SELECT CAST(p_partkey // 3 AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey > 2)""",
    "edges": """edges AS (SELECT source, target, 'prerequisite_of' AS type, 1.0 AS confidence FROM prereq
        UNION ALL SELECT CAST(a.p_partkey AS VARCHAR), CAST(b.p_partkey AS VARCHAR), 'confusable_with', 0.5 FROM part a JOIN part b
            ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
        UNION ALL SELECT CAST(p_partkey // 2 AS VARCHAR), CAST(p_partkey AS VARCHAR), 'related_to', 0.25 FROM part WHERE p_partkey > 1 AND p_partkey % 10 = 0)""",
    "log": """log AS (SELECT user_id % 25 AS user_id, json_extract_string(props, '$.k') AS concept_id, event_id AS seq,
        least(value / 100, 1) * 0.5 AS weight, CAST(ts AS DATE) AS ts, event_type = 'error' AS revoked FROM events)""",
    "mastery": f"""mastery AS (SELECT user_id, concept_id, round(1 - product(CASE WHEN revoked THEN 1.0 ELSE
        1 - greatest(0, least(1, weight)) * pow(0.5, greatest(date_diff('day', ts, DATE '{AS_OF}'), 0) / 60.0) END), 4) AS mastery FROM log GROUP BY ALL)""",
    "one": f"one AS (SELECT concept_id AS id, mastery FROM mastery WHERE user_id = {LEARNER})",
    "up": """up AS (SELECT target AS id, source AS ancestor, 1 AS hop FROM prereq
        UNION SELECT up.id, prereq.source, up.hop + 1 FROM up JOIN prereq ON up.ancestor = prereq.target),
        closure AS (SELECT id, ancestor, min(hop) AS hop FROM up GROUP BY ALL)""",
}
_NEEDS = {"edges": ["prereq"], "mastery": ["log"], "one": ["log", "mastery"], "up": ["prereq"]}


def with_views(*names: str) -> str:
    """WITH clause that defines the named views and what they need."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    return f"WITH {'RECURSIVE ' if 'up' in wanted else ''}" + ", ".join(SQL[n] for n in wanted) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in NODE_TYPES])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("id"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"),
        F.get(kinds, (F.col("p_partkey") % 7).cast("int")).alias("type"),
        F.col("p_brand").alias("domain"),
        F.concat("p_type", F.lit(" size "), F.col("p_size")).alias("desc"),
        (1 + F.col("p_size") % 5).alias("difficulty"),
        F.array("p_type").alias("aliases"),
    )


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that confusable_with joins, (clique, place, id, single): same brand and size; single where no other part has the key."""
    part = table(spark, sf_dir, "part").filter("p_partkey is not null and p_brand is not null and p_size is not null")
    single = F.count("*").over(Window.partitionBy("p_partkey")) == 1
    return part.select(F.concat_ws("|", "p_size", "p_brand").alias("clique"), F.col("p_partkey").alias("place"), F.col("p_partkey").cast("string").alias("id"), single.alias("single"))


def cliques(spark: SparkSession, sf_dir: str) -> Cliques:
    return Cliques(_dealt(spark, sf_dir).filter("single").drop("single"), "confusable_with", 0.5)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that no clique implies: of the first two kinds, and those of parts whose key is not theirs alone."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    half, third = (part.filter(k > n - 1).select(F.floor(k / n).cast("string").alias("source"), k.cast("string").alias("target")) for n in (2, 3))
    pre = half.union(third).distinct().select("source", "target", F.lit("prerequisite_of").alias("type"), F.lit(1.0).alias("confidence"))
    every = _dealt(spark, sf_dir)
    a, b = (every.select("clique", *[F.col(c).alias(f"{x}{c}") for c in ("place", "id", "single")]) for x in "ab")
    conf = a.filter("not asingle").join(b, "clique").unionByName(a.filter("asingle").join(b.filter("not bsingle"), "clique")).filter("aplace < bplace")
    conf = conf.select(F.col("aid").alias("source"), F.col("bid").alias("target"), F.lit("confusable_with").alias("type"), F.lit(0.5).alias("confidence"))
    rel = part.filter("p_partkey > 1 and p_partkey % 10 = 0").select(F.floor(k / 2).cast("string").alias("source"), k.cast("string").alias("target"), F.lit("related_to").alias("type"), F.lit(0.25).alias("confidence"))
    return pre.unionByName(conf).unionByName(rel).withColumn("ord", F.xxhash64("source", "target", "type")).withColumn("note", F.lit(""))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Keys are unique by construction, so the handle is made without the deduplicating build."""
    return Graph(nodes(spark, sf_dir), listed(spark, sf_dir), cliques(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 25).alias("user_id"),
        F.get_json_object("props", "$.k").alias("concept_id"),
        F.col("event_id").alias("seq"),
        (F.least(F.col("value") / 100, F.lit(1.0)) * 0.5).alias("weight"),
        F.to_date("ts").alias("ts"),
        (F.col("event_type") == "error").alias("revoked"),
    )


def mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery_from_log(log(spark, sf_dir), AS_OF)


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery_from_log(log(spark, sf_dir).filter(F.col("user_id") == LEARNER), AS_OF).select("concept_id", "mastery")
