"""Hot and cold tiers: sizes, archive, restore and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators.listing import top_of
from recollect.operators import tiers
from recollect.plans.registry import query
from recollect.sources.tables import WITH, memories, table

M = "WITH " + WITH["memories"]


@query("SELECT label, count(*) AS n, sum(len(embedding) * 4)::BIGINT AS dense_bytes, ((count(*) + 1) * 8 + count(*) * 32 * 12 + count(*) * 40)::BIGINT AS graph_bytes FROM embeddings GROUP BY label")
def k2_size_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(n.alias("n"), F.sum(F.size("embedding") * 4).alias("dense_bytes"), ((n + 1) * 8 + n * 32 * 12 + n * 40).alias("graph_bytes"))


@query("SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey")
def k3_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count_distinct("l_partkey").alias("degree"))


@query(M + """ SELECT workspace, id, content_hash, 'cold' AS tier, (row_number() OVER (PARTITION BY workspace ORDER BY id) - 1) // 10000 AS graph_no FROM memories WHERE importance <= 0.3
  UNION ALL SELECT workspace, id, content_hash, 'hot', NULL FROM memories WHERE importance > 0.3""")
def k7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least important memories move to the cold tier, in graphs of at most 10,000 nodes of a workspace."""
    m = memories(spark, sf_dir).select("workspace", "id", "content_hash", "importance")
    n = F.row_number().over(Window.partitionBy("workspace").orderBy("id"))
    cold = m.filter("importance <= 0.3").select("workspace", "id", "content_hash", F.lit("cold").alias("tier"), F.floor((n - 1) / 10_000).alias("graph_no"))
    return cold.unionByName(m.filter("importance > 0.3").select("workspace", "id", "content_hash", F.lit("hot").alias("tier"), F.lit(None).cast("long").alias("graph_no")))


@query(M + """, r AS (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1) SELECT id, workspace, CASE WHEN importance <= 0.3 AND id NOT IN (SELECT doc_id FROM r) THEN 'cold' ELSE 'hot' END AS tier,
  importance <= 0.3 AND id IN (SELECT doc_id FROM r) AS needs_embedding FROM memories""")
def k8_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold rows that are asked back leave the cold tier and join the hot one, to be embedded again."""
    m = memories(spark, sf_dir).select("id", "workspace", "importance")
    asked = table(spark, sf_dir, "labels").filter("quality = 0 and toxic = 1").select(F.col("doc_id").alias("id"))
    cold = m.filter("importance <= 0.3")
    stays = cold.join(asked, "id", "left_anti").select("id", "workspace", F.lit("cold").alias("tier"), F.lit(False).alias("needs_embedding"))
    back = cold.join(asked, "id", "left_semi").select("id", "workspace", F.lit("hot").alias("tier"), F.lit(True).alias("needs_embedding"))
    hot = m.filter("importance > 0.3").select("id", "workspace", F.lit("hot").alias("tier"), F.lit(False).alias("needs_embedding"))
    return hot.unionByName(back).unionByName(stays)


@query(M + """ SELECT workspace, count(*) FILTER (WHERE importance > 0.3) AS hot, count(*) FILTER (WHERE importance <= 0.3) AS cold, coalesce(sum(length(content)) FILTER (WHERE importance > 0.3), 0)::BIGINT AS hot_chars,
  coalesce(sum(length(content)) FILTER (WHERE importance <= 0.3), 0)::BIGINT AS cold_chars, round(count(*) FILTER (WHERE importance <= 0.3) / count(*), 6) AS cold_share FROM memories GROUP BY workspace""")
def k9_tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold, size = F.col("importance") > 0.3, F.col("importance") <= 0.3, F.char_length("content")
    return memories(spark, sf_dir).groupBy("workspace").agg(F.count_if(hot).alias("hot"), F.count_if(cold).alias("cold"), F.coalesce(F.sum(F.when(hot, size)), F.lit(0)).alias("hot_chars"), F.coalesce(F.sum(F.when(cold, size)), F.lit(0)).alias("cold_chars"), F.round(F.count_if(cold) / F.count(F.lit(1)), 6).alias("cold_share"))


@query(M + " SELECT count(*) AS memories, sum(n_chars)::BIGINT AS chars, count(DISTINCT content_hash) AS texts FROM memories")
def k10_tenant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).agg(F.count(F.lit(1)).alias("memories"), F.sum("n_chars").alias("chars"), F.count_distinct("content_hash").alias("texts"))


@query(M + " SELECT workspace, id, importance FROM memories WHERE importance <= 0.5 AND workspace NOT IN ('src0', 'src1') QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY importance, id) <= 10")
def k11_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the archival sweep: a batch of each workspace that isn't switched off."""
    rows = memories(spark, sf_dir).filter("importance <= 0.5 and workspace not in ('src0', 'src1')").select("workspace", "id", "importance")
    return top_of(rows, ["workspace"], [F.asc("importance"), F.asc("id")], 10).drop("rank")


OVERRIDES = M + """, o AS (SELECT 'src' || (s_suppkey - 1) AS workspace, CASE s_suppkey % 4 WHEN 1 THEN false WHEN 2 THEN true END AS enabled, CASE s_suppkey % 5 WHEN 0 THEN 0.3 WHEN 3 THEN 1.7 END::DOUBLE AS threshold FROM supplier),
  k AS (SELECT workspace, coalesce(enabled, true) AS enabled, coalesce(threshold, 0.5) AS own FROM (SELECT DISTINCT workspace FROM memories) LEFT JOIN o USING (workspace)), c AS (SELECT workspace, id, importance FROM memories JOIN k USING (workspace) WHERE enabled AND own BETWEEN 0 AND 1 AND status = 'active' AND importance <= own)"""


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("s_suppkey")
    overrides = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), n - 1).alias("workspace"), F.when(n % 4 == 1, False).when(n % 4 == 2, True).alias("enabled"), F.when(n % 5 == 0, 0.3).when(n % 5 == 3, 1.7).alias("threshold"))
    return tiers.sweep(memories(spark, sf_dir), overrides)


@query(OVERRIDES + " SELECT workspace, id, importance FROM c QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY importance, id) <= 10")
def k11_sweep_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sweep would archive, by the workspaces' own rules (suppliers stand for these)."""
    return _sweep(spark, sf_dir)[0]


@query(OVERRIDES + ", n AS (SELECT workspace, count(*) AS n FROM c GROUP BY workspace) SELECT workspace, coalesce(n, 0) AS candidates, least(coalesce(n, 0), 10) AS archived, CASE WHEN enabled AND NOT own BETWEEN 0 AND 1 THEN format('threshold {:.2f} is not from 0 to 1', own) END AS error FROM k LEFT JOIN n USING (workspace) WHERE workspace IS NOT NULL")
def k11_sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each workspace fared, its error if its rule is none."""
    return _sweep(spark, sf_dir)[1].filter("workspace is not null")
