"""Vector searches: the rows whose id is divisible by 20 are the queries, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.vectors import cosine
from recollect.operators import vectors as op
from recollect.plans.registry import query
from recollect.sources.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.filter("id % 20 = 0")


SIM = """WITH s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id AS id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""


@query("""WITH r AS (SELECT v.* FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE d.lang IN ('en', 'fr', 'de') AND d.source <> 'src0' AND d.n_chars BETWEEN 20 AND 20000),
  s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings q, r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 12) SELECT query_id, id, similarity, rank FROM t WHERE rank > 2 AND similarity >= 0.2""")
def v1_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among memories of some types, subtypes and a range, an offset skipped; the limit comes before the threshold, so fewer than k may be left."""
    v = _vectors(spark, sf_dir)
    kept = table(spark, sf_dir, "documents").filter("lang in ('en', 'fr', 'de') and source <> 'src0' and n_chars between 20 and 20000").select(F.col("doc_id").alias("id"))
    found = op.search(v.join(kept, "id", "left_semi"), _queries(v), 12)
    return found.filter("rank > 2 and similarity >= 0.2").withColumn("rank", F.col("rank").cast("long"))


@query(SIM + " SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE label IN (1, 3) QUALIFY rank <= 5")
def v2_speaker_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return op.search(v.filter(F.col("label").isin(1, 3)), _queries(v), 5).withColumn("rank", F.col("rank").cast("long"))


CUES = SIM + " , c AS (SELECT query_id, label AS memory_id, max(similarity) AS similarity, arg_min(id, struct_pack(d := -similarity, i := id)) AS cue FROM s GROUP BY ALL) "


@query(CUES + "SELECT query_id, memory_id, similarity, cue FROM c")
def v3_cue_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cue of each memory (label)."""
    v = _vectors(spark, sf_dir)
    return op.search(v, _queries(v), 1, each="label").select("query_id", F.col("each").cast("int").alias("memory_id"), "similarity", F.col("id").alias("cue"))


@query(SIM + " SELECT query_id, label AS memory_id, max(similarity) AS similarity FROM s WHERE label <> query_label AND similarity >= 0.2 GROUP BY query_id, label")
def v4_cue_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories (labels) with a cue near a query's, other than its own."""
    v = _vectors(spark, sf_dir)
    near = op.within(v, _queries(v), 0.2).join(v.select("id", F.col("label").alias("memory_id")), "id")
    asked = _queries(v).select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    return near.join(asked, "query_id").filter("memory_id <> query_label").groupBy("query_id", "memory_id").agg(F.max("similarity").alias("similarity"))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors to a group, as one late-interaction record."""
    v = _vectors(spark, sf_dir)
    one = F.sort_array(F.collect_list(F.struct("id", "embedding")))
    return v.groupBy(F.floor(F.col("id") / 5).alias("group_id")).agg(one.alias("x")).select("group_id", F.col("x.embedding").alias("embeddings"))


TOKENS = """WITH t AS (SELECT vec_id // 5 AS g, vec_id % 5 AS i, embedding::DOUBLE[] AS e FROM embeddings), s AS (
  SELECT q.g AS query_id, q.i AS qi, v.g AS group_id, max(list_cosine_similarity(q.e, v.e)) AS m FROM t q, t v WHERE q.g % 20 = 0 GROUP BY ALL),
  r AS (SELECT query_id, group_id, round(sum(m), 5) + 0.0 AS score FROM s GROUP BY ALL) """


@query(TOKENS + "SELECT query_id, group_id, score FROM r")
def v5_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _multi(spark, sf_dir)
    return op.maxsim(groups, groups.filter("group_id % 20 = 0").withColumnRenamed("group_id", "id"), digits=5)


@query(TOKENS + "SELECT query_id, group_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id) AS rank FROM r QUALIFY rank <= 10")
def v6_maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _multi(spark, sf_dir)
    return op.maxsim(groups, groups.filter("group_id % 20 = 0").withColumnRenamed("group_id", "id"), digits=5, k=10).withColumn("rank", F.col("rank").cast("long"))


@query(TOKENS + "SELECT query_id, group_id, score FROM r WHERE group_id IN (SELECT conv_id FROM conversations)")
def v7_maxsim_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated query tokens count once; only the documents of a set of ids, another table's, are scored."""
    groups = _multi(spark, sf_dir)
    wanted = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"))
    return op.maxsim(groups.join(wanted, "group_id", "left_semi"), groups.filter("group_id % 20 = 0").withColumnRenamed("group_id", "id"), True, 5)


STAGED = TOKENS.replace("WITH t AS", "WITH t AS").rstrip() + """, n AS (SELECT q.vec_id // 5 AS query_id, v.vec_id // 5 AS group_id FROM embeddings q, embeddings v WHERE (q.vec_id // 5) % 20 = 0 AND q.vec_id <> v.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 20)
  SELECT query_id, group_id, score FROM r SEMI JOIN n USING (query_id, group_id)"""


@query(STAGED)
def v8_two_stage_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 tokens nearest to each query token name the groups that are scored exactly."""
    v = _vectors(spark, sf_dir)
    near = op.search(v, v.filter("floor(id / 5) % 20 = 0"), 20)
    named = near.select(F.floor(F.col("query_id") / 5).alias("query_id"), F.floor(F.col("id") / 5).alias("group_id")).distinct()
    groups = _multi(spark, sf_dir)
    return op.maxsim_of(named, groups, groups.withColumnRenamed("group_id", "id"), digits=5)


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings), h AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.s, v.s), lambda z: (z[1] <> z[2])::BIGINT))::BIGINT AS distance FROM b q, b v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
  SELECT query_id, id, distance FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10""")
def v9_binary_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hamming distance of sign bits, by a product of signs."""
    v = _vectors(spark, sf_dir)
    found = op.search(v, _queries(v), 10, signs=True)
    size = v.select(F.max(F.size("embedding"))).scalar()
    return found.select("query_id", "id", F.round((1 - F.col("similarity")) * size / 2).cast("long").alias("distance"))


@query(SIM + " SELECT query_id, id, similarity FROM s WHERE label = query_label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 3")
def v11_same_type_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return op.search(v, _queries(v), 3, same="label").select("query_id", "id", "similarity")


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v12_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    following = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(following, "id").select("id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query()
def v13_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return op.InvertedLists(v).search(_queries(v), 10).withColumn("rank", F.col("rank").cast("long"))


@query(SIM + " SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 32")
def k1_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return op.search(v, _queries(v), 32).withColumn("rank", F.col("rank").cast("long"))


@query(SIM + " SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE id BETWEEN query_id - 50 AND query_id + 50 QUALIFY rank <= 10")
def k5_score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that something cheap names (here ids near the query's), some without a vector, scored exactly."""
    v = _vectors(spark, sf_dir)
    asked = _queries(v)
    near = asked.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.col("id") - 50, F.col("id") + 50)).alias("id")).filter("id <> query_id")
    return op.score_candidates(near, v, asked, 10)
