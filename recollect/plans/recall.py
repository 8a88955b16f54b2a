"""Keyword search, fusion and tiers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.stemming import stems_sql, with_stems
from recollect.operators import recall as op
from recollect.operators.vectors import search
from recollect.plans.registry import query
from recollect.sources.tables import WITH, memories, table

M = "WITH " + WITH["memories"]
BM25 = f"""WITH q0 AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark WHERE item_id % 20 = 0),
  w AS (SELECT doc_id AS id, regexp_extract_all(lower(concat_ws(' ', text, source)), '[a-z0-9]+') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM w),
  u AS (SELECT id, len(ts) AS length, unnest(ts) AS t FROM w), voc AS (SELECT t FROM u UNION SELECT t FROM q0), stems AS ({stems_sql("voc")}), q AS (SELECT DISTINCT query_id, stem AS term FROM q0 JOIN stems ON word = t),
  tf AS (SELECT id, length, stem AS term, count(*) AS tf FROM u JOIN stems ON word = t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL HAVING score > 0),
  bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text is the content and its aliases, here the source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", "source").alias("text"))
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("id"), "text")
    return op.bm25(docs, asked)


@query(BM25 + " SELECT query_id, id, score, rank FROM bm WHERE rank <= 20")
def r1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked(_bm25(spark, sf_dir), 20)


@query(BM25 + ", own AS (SELECT b.* FROM b JOIN documents d ON d.doc_id = b.id WHERE d.lang = ['en', 'fr', 'de'][query_id % 3 + 1]) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM own QUALIFY rank > 5 AND rank <= 15")
def r1_bm25_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among documents of the query's context (a language), the second page of results."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", "source").alias("text"), F.col("lang").alias("context"))
    context = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("item_id") % 3 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("id"), "text", context.alias("context"))
    return op.ranked(op.bm25(docs, asked, same="context"), 10, offset=5)


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) " + stems_sql("w"))
def r1_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each different word of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(op.terms(F.col("text"))).alias("word")).distinct()
    return with_stems(words.withColumnRenamed("word", "w"), "w").withColumnRenamed("w", "word")


HYBRID = BM25.replace("benchmark WHERE item_id % 20 = 0", "benchmark") + """, best AS (SELECT query_id FROM bm WHERE rank = 1 AND score >= 60), poor AS (SELECT DISTINCT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM best)),
  im AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q JOIN poor ON poor.query_id = q.vec_id, embeddings v WHERE q.vec_id <> v.vec_id),
  im2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM im QUALIFY rank <= 5)
  SELECT query_id, id, score, rank, 'rag' AS mode FROM bm SEMI JOIN best USING (query_id) WHERE rank <= 5 UNION ALL SELECT query_id, id, score, rank, 'llm' FROM im2"""


@query(HYBRID)
def r8_hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose best score by keyword is under a threshold are searched again by vector; the others are not."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", "source").alias("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    by_vector = lambda poor: search(v, v.join(poor.select("id"), "id", "left_semi"), 5).select("query_id", "id", F.col("similarity").alias("score"), F.col("rank").cast("long").alias("rank"))
    return op.fallback(op.ranked(op.bm25(docs, asked), 5), asked, 60.0, by_vector)


@query("SELECT event_id, event_type || ' ' || coalesce(json_extract_string(props, '$.k'), '') AS searchable FROM events")
def r2_searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" "), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("searchable"))


FUSED = BM25 + """, im AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT query_id FROM q) AND q.vec_id <> v.vec_id),
  f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM im WHERE rank <= 50) GROUP BY ALL)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 20"""


@query(FUSED)
def r3_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by keyword fused with the nearest by vector; an item's and a document's vector are those of their ids."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("id"))
    return op.fuse([op.ranked(_bm25(spark, sf_dir), 50), search(v, v.join(asked, "id", "left_semi"), 50)], 20)


TIERS = M + """, hot AS (SELECT workspace, id, importance, 0 AS tier FROM memories WHERE status = 'active' AND importance >= 0.5), cold AS (SELECT workspace, id, importance, 1 AS tier FROM memories WHERE importance <= 0.5),
  o AS (SELECT * FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold) QUALIFY row_number() OVER (PARTITION BY workspace, id ORDER BY tier) = 1)"""


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = memories(spark, sf_dir).select("workspace", "id", "importance", "status")
    return m.filter("status = 'active' and importance >= 0.5").drop("status"), m.filter("importance <= 0.5").drop("status")


@query(TIERS + " SELECT workspace, id, importance, tier, row_number() OVER (PARTITION BY workspace ORDER BY importance DESC, id) AS rank FROM o QUALIFY rank <= 20")
def r5_hot_cold_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_tiers(*_tiers(spark, sf_dir), ["workspace"], 20)


@query(TIERS + """, e AS (SELECT DISTINCT workspace, workspace NOT IN (SELECT source FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) < 5) AS enabled FROM memories), u AS (SELECT o.* FROM o JOIN e USING (workspace) WHERE tier = 0 OR enabled)
  SELECT workspace, id, importance, row_number() OVER (PARTITION BY workspace ORDER BY tier, importance DESC, id) AS rank FROM u QUALIFY rank <= 15""")
def r4_tiered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot first; the cold tier, where it is enabled, fills what hot leaves of the limit."""
    hot, cold = _tiers(spark, sf_dir)
    off = table(spark, sf_dir, "documents").filter("lang = 'es' and source is not null").groupBy(F.col("source").alias("workspace")).agg(F.count(F.lit(1)).alias("n")).filter("n < 5")
    return op.fill(hot, cold.join(off, "workspace", "left_anti"), ["workspace"], 15)


@query(M + " SELECT workspace, id, importance AS score FROM memories WHERE status = 'archived' QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY importance DESC, id) <= 5")
def r7_cold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.operators.listing import top_of

    cold = memories(spark, sf_dir).filter("status = 'archived'").select("workspace", "id", F.col("importance").alias("score"))
    return top_of(cold, ["workspace"], [F.desc("score"), F.asc("id")], 5).drop("rank")


@query(TIERS + ", c AS (SELECT * FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold) QUALIFY row_number() OVER (PARTITION BY workspace, id ORDER BY tier DESC) = 1) SELECT workspace, id, tier, row_number() OVER (PARTITION BY workspace ORDER BY tier DESC, importance DESC, id) AS rank FROM c QUALIFY rank <= 15")
def r10_cold_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hot, cold = _tiers(spark, sf_dir)
    both = cold.withColumn("tier", F.lit(1)).union(hot.join(cold.select("id"), "id", "left_anti").select("workspace", "id", "importance").withColumn("tier", F.lit(0)))
    order = Window.partitionBy("workspace").orderBy(F.desc("tier"), F.desc("importance"), "id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 15").drop("importance")
