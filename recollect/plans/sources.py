"""Formats, polls and the smaller operators that lists, relations and profiles have besides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators import datasets, graph, listing
from recollect.operators.vectors import search
from recollect.plans.registry import query
from recollect.sources import formats
from recollect.sources.shared import shared_dir
from recollect.sources.tables import WITH, edges, memories, table


NAMES = ["csv", "TSV", "parquet", "pq", "jsonl", "NDJSON", "json", "xlsx", "XLS", "bin"]


def _file(suffixes: list[str]):
    """A file name for each part; its size says with which suffix."""
    return F.concat(F.lit("data.v1-"), "p_partkey", F.lit("."), F.element_at(F.array(*map(F.lit, suffixes)), (F.col("p_size") % len(suffixes) + 1).cast("int")))


@query(f"""SELECT p_partkey, (['csv', 'csv', 'parquet', 'parquet', 'json', 'json', 'json', 'excel', 'excel', NULL])[p_size % 10 + 1] AS format, p_size % 10 = 9 AS is_error FROM part""".replace("['csv', 'csv'", "['csv', 'tsv'"))
def s1_format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format that a file's name tells, in any case of letters; no format is an error."""
    found = formats.kind(_file(NAMES), formats.DATASETS | {"xlsx": "excel", "xls": "excel"})
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("format"), found.isNull().alias("is_error"))


def _round_trip(spark: SparkSession, df: DataFrame, suffix: str, schema: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}.{suffix}"
    formats.write(df, path)
    return formats.read(spark, path, schema)


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s2_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return _round_trip(spark, columns, "csv", "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def s2_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "tsv", "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


@query("SELECT conv_id, turn, role, text FROM conversations")
def s3_ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "conversations"), "ndjson").select("conv_id", "turn", "role", "text")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s5_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "parquet")


@query()
def s8_filesystem_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written out as files, then polled: a hash and size for each file."""
    path = f"{shared_dir(spark)}/poll-{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").select("url", "html").write.json(path)
    return formats.poll_files(spark, path, "*.json").drop("source_path")


@query("SELECT sha256(html) AS content_hash, min(url) AS source_path FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE starts_with(url, 'http://')) GROUP BY 1")
def s16_catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of secure hosts, synced against a catalog that holds the others."""
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), F.sha2("html", 256).alias("content_hash"))
    known = rows.filter(F.startswith("source_path", F.lit("http://")))
    return formats.new_files(rows, known).select("content_hash", "source_path")


@query("""WITH c AS (SELECT source, count(*) AS total FROM documents GROUP BY source) SELECT d.source AS collection, doc_id AS article, lang, substr(text, 1, 80) AS title, total FROM documents d JOIN c ON c.source IS NOT DISTINCT FROM d.source
  QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY doc_id DESC) <= 20""")
def f23_kb_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles of each collection, and how many it has."""
    docs = table(spark, sf_dir, "documents")
    totals = docs.groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("total"))
    page = listing.top_of(docs.select(F.col("source").alias("collection"), F.col("doc_id").alias("article"), "lang", F.substring("text", 1, 80).alias("title")), ["collection"], [F.desc("article")], 20).drop("rank")
    return page.join(totals, page["collection"].eqNullSafe(totals["collection"])).drop(totals["collection"])


@query("SELECT p_brand AS scope, p_name AS name, min(p_partkey) AS id FROM part WHERE p_size > 40 OR p_type LIKE '%STEEL%' OR p_retailprice < 950 GROUP BY p_brand, p_name")
def f24_scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = (F.col("p_size") > 40) | F.col("p_type").contains("STEEL") | (F.col("p_retailprice") < 950)
    return table(spark, sf_dir, "part").filter(scopes).groupBy(F.col("p_brand").alias("scope"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query("""SELECT column_name AS "column", CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'unknown' END AS type
  FROM (DESCRIBE lineitem) t(column_name, data_type, n, k, d, e)""")
def d16_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.types(table(spark, sf_dir, "lineitem"))


ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


@query("SELECT string_agg(line, chr(10) ORDER BY line) AS prompt FROM (" + " UNION ALL ".join(f"SELECT '{c}: ' || count(DISTINCT {c}) || ' distinct, ' || (count(*) - count({c})) || ' null' AS line FROM orders" for c in ORDERS) + ")")
def d18_profile_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each column."""
    profile = datasets.null_profile(table(spark, sf_dir, "orders").select(*ORDERS))
    lines = profile.select(F.format_string("%s: %d distinct, %d null", "column", "n_unique", "nulls").alias("line"))
    return lines.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("prompt"))  # a line a column


SAMPLED = ["doc_id", "lang", "source", "n_chars", "head"]
QUOTED = ", ".join(f"CASE WHEN regexp_matches({c}::VARCHAR, '[\",\\r\\n]') THEN '\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"' ELSE coalesce({c}::VARCHAR, '') END" for c in SAMPLED)


@query("WITH d AS (SELECT doc_id, nullif(lang, 'en') AS lang, source, n_chars, text || CASE WHEN doc_id % 3 = 0 THEN ', \"quoted\"' ELSE '' END AS head FROM documents ORDER BY doc_id LIMIT 10) SELECT '" + ",".join(SAMPLED) + "' || chr(10) || string_agg(concat_ws(',', " + QUOTED + "), chr(10) ORDER BY doc_id) AS sample FROM d")
def d19_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows as CSV text, whole texts, nulls and quotes among them."""
    head = F.concat("text", F.when(F.col("doc_id") % 3 == 0, ', "quoted"').otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "source", "n_chars", head.alias("head"))
    first = listing.page(rows, [F.asc("doc_id")], 10)
    lines = F.sort_array(F.collect_list(F.struct("doc_id", datasets.csv_line(SAMPLED).alias("line"))))["line"]
    return first.agg(F.concat(F.lit(",".join(SAMPLED) + "\n"), F.array_join(lines, "\n")).alias("sample"))


@query("""WITH e AS (SELECT label FROM embeddings GROUP BY label HAVING min(vec_id) < 5), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings q, embeddings v
  WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.label IN (FROM e)) SELECT query_id, id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 8""")
def v10_collection_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest enabled collections: those of the labels that an early row has."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    enabled = v.groupBy("label").agg(F.min("id").alias("first")).filter("first < 5").select("label")
    return search(v.join(enabled, "label", "left_semi"), v.filter("id % 20 = 0"), 8).drop("rank")


@query("""WITH c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings q, embeddings v JOIN labels l ON l.doc_id = v.vec_id AND l.quality = 0 WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
  SELECT query_id, id, similarity FROM c WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5""")
def r6_cold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold tier (labelled of low quality) by embedding, above a threshold."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cold = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return search(v.join(cold, "id", "left_semi"), v.filter("id % 20 = 0"), 5).filter("similarity >= 0.1").drop("rank")


@query("WITH " + WITH["edges"] + """, v AS (SELECT 'n' || n_nationkey AS id, 'nation' AS layer FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier)
  SELECT source_id, target_id, a.layer AS source_layer, b.layer AS target_layer FROM edges JOIN v a ON a.id = source_id JOIN v b ON b.id = target_id""")
def g13_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers rebuilt: a scope (nations from 20 on, customers) is deleted, what is there is merged, edges without both ends are dropped."""
    layers = {"nation": ("n", "n_nationkey"), "region": ("r", "r_regionkey"), "supplier": ("s", "s_suppkey"), "customer": ("c", "c_custkey")}
    held = None
    for layer, (mark, key) in layers.items():
        rows = table(spark, sf_dir, layer).select(F.concat(F.lit(mark), key).alias("id"), F.lit(layer).alias("layer"), F.col(key).cast("long").alias("key"))
        held = rows if held is None else held.unionByName(rows)
    return graph.both_ends(edges(spark, sf_dir), held.filter("not (layer = 'customer' or layer = 'nation' and key >= 20)"))


@query("WITH t AS (SELECT source AS workspace, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY source), s AS (SELECT source AS workspace, count(*) AS n, max(doc_id) AS latest FROM documents WHERE lang <> 'es' GROUP BY source) SELECT workspace, (t.n = s.n AND t.latest = s.latest) IS TRUE AS skip FROM t LEFT JOIN s USING (workspace)")
def g14_change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which workspaces need no rebuild: their token equals the one saved before Spanish texts came."""
    docs = table(spark, sf_dir, "documents")

    def token(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("source").alias("workspace")).agg(F.struct(F.count(F.lit(1)), F.max("doc_id")).alias("token"))

    held = token(docs.filter("lang <> 'es'")).withColumnRenamed("token", "held")
    return token(docs).join(held, "workspace", "left").select("workspace", F.coalesce(F.col("token") == F.col("held"), F.lit(False)).alias("skip"))


@query("""WITH rel AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O'), h1 AS (SELECT s AS seed, p FROM rel WHERE s % 20 = 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY p) <= 5),
  h2 AS (SELECT seed, h1.p AS part, rel.s AS other FROM h1 JOIN rel ON rel.p = h1.p AND rel.s <> seed) SELECT seed, part, other FROM h2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY part, other) <= 15""")
def g17_relation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops along relations with active evidence, each hop's edge budget spent in id order."""
    rel = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("part")).distinct()
    first = listing.top_of(rel.filter("seed % 20 = 0"), ["seed"], [F.asc("part")], 5).drop("rank")
    onward = first.join(rel.withColumnRenamed("seed", "other"), "part").filter("other <> seed")
    return listing.top_of(onward, ["seed"], [F.asc("part"), F.asc("other")], 15).select("seed", "part", "other")


@query("SELECT o_orderkey AS id, o_orderstatus <> 'P' OR o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 100 DAY AS claimed FROM orders")
def p8_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is claimed unless it is in flight and fresh; a single writer sets it."""
    orders = table(spark, sf_dir, "orders")
    stale = F.col("o_orderdate") < orders.agg(F.max("o_orderdate") - F.expr("interval 100 days")).scalar()
    return orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderstatus") != "P") | stale).alias("claimed"))


@query("""WITH bad AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) >= 50)
  SELECT l_orderkey, l_linenumber, CASE WHEN l_discount + l_tax <= 0.1 AND l_quantity <= 45 THEN round(l_discount, 2) || ',' || round(l_discount + l_tax, 2) END AS box, sha256(l_partkey::VARCHAR) AS hash FROM lineitem WHERE l_orderkey NOT IN (FROM bad)""")
def p17_layout_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box that leaves the page becomes null and its region stays; a layout (order) with a bad region is rejected whole."""
    lines = table(spark, sf_dir, "lineitem")
    bad = lines.groupBy("l_orderkey").agg(F.max("l_quantity").alias("most")).filter("most >= 50")
    ok = (F.col("l_discount") + F.col("l_tax") <= 0.1) & (F.col("l_quantity") <= 45)
    box = F.when(ok, F.concat_ws(",", F.round("l_discount", 2).cast("string"), F.round(F.col("l_discount") + F.col("l_tax"), 2).cast("string")))
    return lines.join(bad, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", box.alias("box"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"))


@query("WITH " + WITH["memories"] + " SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(DISTINCT workspace) FROM memories) AS workspaces, (SELECT count(DISTINCT conv_id) FROM conversations) AS threads, (SELECT count(*) FROM pages) AS pages")
def a2_platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("workspace").alias("workspaces"))
    threads = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).scalar()
    return m.withColumn("threads", threads).withColumn("pages", table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar())


@query("SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events WHERE event_type = 'purchase'")
def m4_skill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mutation beside the revision it replaces."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"))
