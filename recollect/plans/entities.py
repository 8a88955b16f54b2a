"""Entity queries: parts as entities that orders mention, brands and types as their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.predicates import collapse, entity_name
from recollect.operators import entities as op
from recollect.operators import graph
from recollect.operators.listing import top_of
from recollect.operators.vectors import near_links
from recollect.plans.registry import query
from recollect.sources.shared import spread
from recollect.sources.tables import members, memories, table


@query("""WITH p AS (SELECT p_partkey AS id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, CASE WHEN p_type LIKE '%BRASS%' THEN 'person' ELSE 'thing' END AS kind, lower(p_brand) AS alias FROM part WHERE p_size > 3)
  SELECT name, min(id) FILTER (WHERE kind = 'thing') AS exact_id, arg_min(id, (kind <> 'person')::INT * 1000000000 + id) AS any_id, (SELECT count(DISTINCT a.id) FROM p a WHERE a.alias = min(p.alias)) AS by_alias FROM p GROUP BY name""")
def e1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active entities of each name: of one type, of any type with persons first, and how many have its alias."""
    kind = F.when(F.col("p_type").contains("BRASS"), "person").otherwise("thing")
    p = table(spark, sf_dir, "part").filter("p_size > 3").select(F.col("p_partkey").alias("id"), entity_name(F.col("p_name")).alias("name"), kind.alias("kind"), F.lower("p_brand").alias("alias"))
    aliases = p.groupBy("alias").agg(F.count_distinct("id").alias("by_alias"))
    return op.lookup(p, "thing").join(aliases, "alias").select("name", "exact_id", "any_id", "by_alias")


@query("""WITH k AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey < 3 THEN (SELECT min(p_name) FROM part) WHEN s_suppkey < 5 THEN (SELECT upper(min(p_brand)) FROM part) ELSE s_name END AS name FROM supplier), n AS (SELECT id, name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM k),
  x AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key, min(p_partkey) AS e FROM part GROUP BY 1), a AS (SELECT lower(trim(regexp_replace(p_brand, '\\s+', ' ', 'g'))) AS key, min(p_partkey) AS e FROM part GROUP BY 1),
  u AS (SELECT id FROM n WHERE key NOT IN (SELECT key FROM x) AND key NOT IN (SELECT key FROM a)),
  v AS (SELECT q.vec_id AS id, p.vec_id AS e, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) + 0.0 AS w FROM embeddings q JOIN u ON u.id = q.vec_id JOIN embeddings p ON p.vec_id <> q.vec_id WHERE p.vec_id IN (SELECT p_partkey FROM part)),
  b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, e) = 1)
  SELECT n.id, coalesce(x.e, a.e, CASE WHEN b.w >= 0.4 THEN b.e END) AS entity_id, CASE WHEN b.w < 0.4 AND b.w >= 0.3 THEN b.e END AS candidate, CASE WHEN x.e IS NOT NULL THEN 'exact' WHEN a.e IS NOT NULL THEN 'alias' WHEN b.w >= 0.4 THEN 'embedding' WHEN b.w >= 0.3 THEN 'candidate' ELSE 'new' END AS tier
  FROM n LEFT JOIN x USING (key) LEFT JOIN a USING (key) LEFT JOIN b ON b.id = n.id""")
def e2_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers resolved among parts: by name, by alias (brand), then by the vectors of both, at thresholds that fit these vectors."""
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    name, brand = part.agg(F.min("p_name")).scalar(), part.agg(F.upper(F.min("p_brand"))).scalar()
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") < 3, name).when(F.col("s_suppkey") < 5, brand).otherwise(F.col("s_name")).alias("name"))
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    known = vectors.join(part.select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return op.resolve(names, entities, part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias")), vectors, known, 0.4, 0.3)


CLUSTERS = """WITH RECURSIVE s AS (SELECT q.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS w FROM embeddings q, embeddings v WHERE q.vec_id < v.vec_id),
  l AS (SELECT a, b FROM s WHERE w >= 0.3), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
  k AS (SELECT node, min(root) AS root FROM r GROUP BY node), c AS (SELECT vec_id AS node, coalesce(k.root, vec_id) AS root FROM embeddings LEFT JOIN k ON k.node = vec_id), m AS (SELECT c.node, c.root, count(e.vec_id) AS members FROM c LEFT JOIN embeddings e ON e.label = c.node % 10 GROUP BY ALL)
  SELECT node, first_value(node) OVER (PARTITION BY root ORDER BY members DESC, node) AS representative FROM m"""


@query(CLUSTERS)
def e3_dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    linked = graph.components(near_links(v, 0.3))
    roots = v.select(F.col("id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labels = v.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    sizes = roots.select("node", (F.col("node") % 10).alias("label")).join(labels, "label", "left").select("node", "members")
    return op.representatives(roots, sizes)


@query("WITH t AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS target FROM part) SELECT DISTINCT target AS entity_id, l_orderkey AS memory_id, l_returnflag AS role FROM lineitem JOIN t ON l_partkey = p_partkey")
def e4_reassignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and type become the least of them."""
    part = table(spark, sf_dir, "part")
    least = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("target"))
    return op.reassign(members(spark, sf_dir), part.join(least, ["p_brand", "p_type"]).select(F.col("p_partkey").alias("entity_id"), "target"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_returnflag AS relationship, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linenumber END AS span, l_orderkey AS hash, l_discount AS c FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)),
  o AS (SELECT source, target, relationship, coalesce(span, -1) AS span, hash, max(1 - c) AS confidence FROM e GROUP BY ALL) SELECT source, target, relationship, count(*) AS evidence, round(avg(confidence), 6) AS confidence FROM o GROUP BY ALL""")
def e6_relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends are both active: suppliers in credit, parts over a size."""
    rows = table(spark, sf_dir, "lineitem")
    span = F.when(F.col("l_linestatus") != "O", F.col("l_linenumber"))
    evidence = rows.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relationship"), span.alias("span"), F.col("l_orderkey").alias("hash"), (1 - F.col("l_discount")).alias("confidence"))
    active = [table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("source")), table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("target"))]
    return op.relation_upsert(evidence.join(active[0], "source", "left_semi").join(active[1], "target", "left_semi"))


@query("""WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS rep FROM part), l AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_discount) AS b, l_returnflag AS relationship, l_orderkey AS hash, 1 - l_discount AS c FROM lineitem),
  x AS (SELECT s.rep AS source, t.rep AS target, relationship, hash, max(c) AS c FROM l JOIN m s ON a = s.p_partkey JOIN m t ON b = t.p_partkey GROUP BY ALL)
  SELECT source, target, relationship, count(*) AS evidence, round(avg(c), 6) AS confidence, source <> target AS active FROM x GROUP BY ALL""")
def e5_relation_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of parts that follow each other in an order, re-pointed to merged parts."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    least = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("to"))
    merged = part.join(least, ["p_brand", "p_type"]).select(F.col("p_partkey").alias("id"), "to")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_discount"))
    relations = lines.select(F.col("l_partkey").alias("source"), following.alias("target"), F.col("l_returnflag").alias("relationship"), F.lit(None).cast("int").alias("span"), F.col("l_orderkey").alias("hash"), (1 - F.col("l_discount")).alias("confidence"))
    return op.reconcile(relations.filter("target is not null"), merged)


@query("SELECT p_brand AS entity, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS aliases, count(*) AS n FROM part GROUP BY p_brand")
def e7_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brands = part.groupBy(F.col("p_brand").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    listed = op.with_aliases(brands, part.select(F.col("p_brand").alias("entity_id"), F.col("p_type").alias("alias")))
    return listed.select(F.col("entity_id").alias("entity"), F.array_join("aliases", "|").alias("aliases"), "n")


@query("""WITH d AS (SELECT sha256(text) AS h, doc_id, max(doc_id) OVER (PARTITION BY sha256(text)) AS newer FROM documents) SELECT DISTINCT doc_id AS id FROM d WHERE doc_id <> newer""")
def e8_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of copies of a text, each older one contradicts the newest."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    newest = docs.groupBy("h").agg(F.max("doc_id").alias("newer"))
    sides = docs.join(newest, "h").filter("doc_id <> newer").select(F.col("doc_id").alias("a"), F.col("newer").alias("b"), "newer", F.lit(False).alias("resolved"))
    return op.superseded(sides)


@query("""WITH l AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS support, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag <> 'R') AS known, list(l_partkey) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 45) AS open, avg(l_quantity) / 40 AS c FROM lineitem GROUP BY 1)
  SELECT id, round(greatest(0.0, least(1.0, c)), 6)::DOUBLE AS confidence, array_to_string(list_filter(list_filter(support, lambda x, i: list_position(support, x) = i), lambda x: list_contains(coalesce(known, []), x)), ',') AS support, coalesce(list_has_any(list_filter(support, lambda x: list_contains(coalesce(known, []), x)), open), false) AS flagged FROM l""")
def e9_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of orders: their parts as support, those not returned known, large open lines unresolved."""
    at = lambda rule: F.sort_array(F.collect_list(F.when(rule, F.struct("l_linenumber", "l_partkey"))))["l_partkey"]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.avg("l_quantity") / 40).alias("c"), at(F.lit(True)).alias("support"), at(F.col("l_returnflag") != "R").alias("known"), at((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).alias("open"))
    confidence, support, flagged = op.belief(F.col("c"), F.col("support"), F.col("known"), F.col("open"))
    return rows.select("id", F.round(confidence, 6).alias("confidence"), F.array_join(support, ",").alias("support"), flagged.alias("flagged"))


@query("SELECT conv_id, turn, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')), 1, 500) AS prompt FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 20")
def e10_prompt_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 prompts of a thread, white space collapsed, 500 characters at most."""
    first = top_of(table(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn")], 20)
    return first.select("conv_id", "turn", F.substring(collapse(F.col("text")), 1, 500).alias("prompt"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'neutral' WHEN event_type = 'click' THEN 'supports' WHEN event_type = 'error' THEN 'contradicts' ELSE 'neutral' END AS verdict FROM events")
def e11_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "entailment").when(F.col("event_type") == "error", "contradiction").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", op.nli(label, F.col("value"), 20).alias("verdict"))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS k FROM lineitem), ok AS (SELECT e FROM m GROUP BY e HAVING count(*) >= 2), x AS (SELECT a.e AS entity_id, b.e AS other, count(*) AS n FROM m a JOIN m b ON a.k = b.k AND a.e <> b.e WHERE a.e % 20 = 0 AND b.e IN (FROM ok) GROUP BY a.e, b.e)
  SELECT entity_id, other, n FROM x QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, other) <= 8""")
def e13_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = members(spark, sf_dir)
    m = spread(every, every.count(), "memory_id").select("entity_id", "memory_id").distinct()
    eligible = m.groupBy(F.col("entity_id").alias("other")).agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    pairs = graph.comention(m, F.col("entity_id") % 20 == 0).join(eligible, "other", "left_semi")
    return top_of(pairs.withColumnRenamed("shared", "n"), ["entity_id"], [F.desc("n"), F.asc("other")], 8).drop("rank")


@query("SELECT p_brand AS article, sha256(p_brand || '|' || string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR)) AS content_key FROM part GROUP BY p_brand")
def e14_article_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.sort_array(F.collect_list(F.col("p_partkey").cast("string"))), ",")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("article")).agg(F.sha2(F.concat("p_brand", F.lit("|"), ids), 256).alias("content_key"))


@query("SELECT event_id, event_type = 'click' AND value / 60 >= 0.85 AS merge FROM events")
def e15_adjudication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict of sameness merges only with enough confidence."""
    return table(spark, sf_dir, "events").select("event_id", op.merges(F.col("event_type") == "click", F.col("value") / 60).alias("merge"))


@query("""SELECT sha256(text) AS content_hash, max(doc_id) AS id, count(*)::BIGINT AS revision, array_to_string(list_sort(list(doc_id)), ',') AS history FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def r11_merge_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies merged without a model's decision: the newest stays and keeps the ids it replaced."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("id"))
    return op.merged(docs, "content_hash").filter("revision > 1").withColumn("history", F.array_join("history", ","))


@query("""WITH p AS (SELECT p_partkey AS e, CASE WHEN p_type LIKE '%BRASS%' THEN 'person' ELSE 'thing' END AS kind, lower(trim(regexp_replace(p_brand, '\\s+', ' ', 'g'))) AS key FROM part WHERE p_size > 3), b AS (SELECT key, arg_min(e, (kind <> 'person')::INT * 1000000000 + e) AS entity_id FROM p GROUP BY key)
  SELECT s_suppkey AS id, entity_id FROM supplier JOIN b ON b.key = 'brand#' || (s_suppkey % 70)""")
def e1_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active entities by alias: brands stand for aliases, asked for in other letters and with other blanks."""
    kind = F.when(F.col("p_type").contains("BRASS"), "person").otherwise("thing")
    part = table(spark, sf_dir, "part").filter("p_size > 3")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("  BRAND#"), F.col("s_suppkey") % 70, F.lit("  ")).alias("name"))
    return op.by_alias(names, part.select(F.col("p_partkey").alias("entity_id"), kind.alias("kind")), part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias")))


NEAR = """WITH RECURSIVE s AS (SELECT q.vec_id AS a, v.vec_id AS b FROM embeddings q, embeddings v WHERE q.vec_id < v.vec_id AND round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) >= 0.4), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
  r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), k AS (SELECT node, min(root) AS root FROM r GROUP BY node),
  m AS (SELECT d.doc_id AS id, sha256(d.text) AS content_hash, CASE l.quality WHEN 1 THEN 0.75 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS importance FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL AND d.doc_id IN (SELECT vec_id FROM embeddings)),
  g AS (SELECT m.*, coalesce(k.root, m.id) AS root FROM m LEFT JOIN k ON k.node = m.id)
  SELECT max(id) AS id, count(*) AS revision, arg_max(content_hash, id) AS content_hash, max(importance) AS importance, array_to_string(list(id || ':' || content_hash ORDER BY id)[1:-2], ',') AS history FROM g GROUP BY root"""


@query(NEAR)
def r11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose vectors are near, along chains, become one that keeps what it replaced."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    m = memories(spark, sf_dir).filter("content is not null").join(vectors.select("id"), "id", "left_semi").select("id", "content_hash", "importance")
    links = near_links(vectors, 0.4)
    told = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["id"].cast("string"), h["content_hash"])), ",")
    return op.merged_near(m, links).withColumn("history", told)
