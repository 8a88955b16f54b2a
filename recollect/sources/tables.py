"""The given tables, and the logical tables that are projections of them.

Each adapter has its SQL twin in ``WITH``, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WITH = {
    "memories": """memories AS (SELECT d.doc_id AS id, d.text AS content, sha256(d.text) AS content_hash, d.lang AS type, d.source AS workspace, d.n_chars,
      CASE l.quality WHEN 1 THEN 0.75 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS importance,
      CASE WHEN l.toxic = 1 THEN 'archived' ELSE 'active' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "edges": """edges AS (SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'part_of' AS relationship, 1.0::DOUBLE AS strength FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 0.5 FROM supplier
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in', 0.25 FROM customer)""",
    "members": "members AS (SELECT l_partkey AS entity_id, l_orderkey AS memory_id, l_returnflag AS role FROM lineitem)",
    "operations": """operations AS (SELECT user_id AS resource_id, event_id AS sequence, event_type AS op, value, ts FROM events)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: importance from the quality label, status from the toxic one."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    importance = F.when(F.col("quality") == 1, 0.75).when(F.col("quality") == 0, 0.25).otherwise(0.5)
    status = F.when(F.col("toxic") == 1, "archived").otherwise("active")
    return d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("type"), F.col("source").alias("workspace"), "n_chars", importance.alias("importance"), status.alias("status"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed graph: nations part of regions, suppliers and customers in nations."""

    def edge(name: str, source: str, key: str, target: str, to: str, relationship: str, strength: float) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(source), key).alias("source_id"), F.concat(F.lit(target), to).alias("target_id"), F.lit(relationship).alias("relationship"), F.lit(strength).alias("strength"))

    return edge("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of", 1.0).union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in", 0.5)).union(edge("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in", 0.25))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities that orders, as memories, mention."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("memory_id"), F.col("l_returnflag").alias("role"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an ordered log of operations on one resource."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("resource_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("op"), "value", "ts")
