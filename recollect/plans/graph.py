"""Graph queries over the typed graph of nations, regions, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import graph as op
from recollect.operators.listing import top_of
from recollect.plans.registry import query
from recollect.sources.shared import spread
from recollect.sources.tables import WITH, edges, members, table

E = "WITH RECURSIVE " + WITH["edges"]
B = E + ", st AS (SELECT source_id AS src, target_id AS dst FROM edges UNION SELECT target_id, source_id FROM edges)"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))


@query(E + " SELECT n.id AS node, count(*) FILTER (WHERE e.source_id = n.id) AS outgoing, count(*) FILTER (WHERE e.target_id = n.id) AS incoming FROM (SELECT 'n' || n_nationkey AS id FROM nation) n JOIN edges e ON e.source_id = n.id OR e.target_id = n.id GROUP BY n.id")
def g1_incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ends = e.select(F.col("source_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col("target_id").alias("node"), F.lit(0), F.lit(1)))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return ends.join(nations, "node", "left_semi").groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


HOPS = B + """, h0 AS (SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS node, 0 AS depth FROM supplier),
  h1 AS (SELECT DISTINCT root, dst AS node, 1 AS depth FROM h0 JOIN st ON src = node), h2 AS (SELECT DISTINCT root, dst AS node, 2 AS depth FROM h1 JOIN st ON src = node),
  hops AS (SELECT root, node, min(depth)::INT AS depth FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY ALL)"""


@query(HOPS + " SELECT root, node, depth FROM hops")
def g2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes within two steps of each supplier."""
    return op.k_hop(edges(spark, sf_dir), _suppliers(spark, sf_dir), 2)


TRUNCATED = HOPS + """, kept AS (SELECT root, node, count(*) OVER (PARTITION BY root) > 65 AS truncated FROM hops QUALIFY row_number() OVER (PARTITION BY root ORDER BY node <> root, node) <= 65)"""


@query(TRUNCATED + " SELECT a.root, source_id, target_id, relationship FROM edges e JOIN kept a ON a.node = e.source_id JOIN kept b ON b.node = e.target_id AND a.root = b.root")
def g2_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among the nodes that each supplier's neighbourhood keeps."""
    return op.neighbourhood(edges(spark, sf_dir), _suppliers(spark, sf_dir), 2, limit=65)[1].drop("strength")


@query(TRUNCATED + " SELECT root, count(*) AS nodes, any_value(truncated) AS truncated FROM kept GROUP BY root")
def g2_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op.neighbourhood(edges(spark, sf_dir), _suppliers(spark, sf_dir), 2, limit=65)[0]
    return kept.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.bool_or("truncated").alias("truncated"))


@query("""SELECT event_id, CASE WHEN NOT regexp_matches(CASE WHEN event_id % 7 = 0 THEN props ELSE 'u' || user_id END, '^[A-Za-z0-9_-]{1,256}$') THEN 'id' WHEN NOT regexp_matches(CASE WHEN event_id % 11 = 0 THEN event_type || ' x' ELSE event_type END, '^[A-Za-z0-9_-]{1,128}$') THEN 'relationship'
  WHEN NOT coalesce(floor(value / 10)::BIGINT BETWEEN 1 AND 6, false) THEN 'hops' END AS refused FROM events""")
def g20_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many requests for a traversal are refused, and for what."""
    id_ = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.concat(F.lit("u"), "user_id"))
    relation = F.when(F.col("event_id") % 11 == 0, F.concat("event_type", F.lit(" x"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", op.refused(id_, relation, F.floor(F.col("value") / 10)).alias("refused"))


@query(HOPS + " , k AS (SELECT DISTINCT node FROM hops) SELECT source_id, target_id, relationship FROM edges WHERE source_id IN (FROM k) AND target_id IN (FROM k)")
def g3_k_hop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return op.induced(e, op.within_hops(e, _suppliers(spark, sf_dir), 2)).select("source_id", "target_id", "relationship")


@query(E + """, x AS (SELECT s_suppkey, 's' || s_suppkey AS a, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)
  SELECT p.a AS source, q.a AS target, CASE WHEN p.n = q.n THEN 2 ELSE 4 END AS hops, CASE WHEN p.n = q.n THEN p.a || ' ' || p.n || ' ' || q.a ELSE p.a || ' ' || p.n || ' ' || p.r || ' ' || q.n || ' ' || q.a END AS path
  FROM x p JOIN x q ON q.s_suppkey = p.s_suppkey + 1 WHERE p.n = q.n OR p.r = q.r""")
def g4_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier to the one of the next key, by nations and regions alone, so paths are unique."""
    s = table(spark, sf_dir, "supplier")
    pairs = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), (F.col("s_suppkey") + 1).alias("k"))
    pairs = pairs.join(s.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), "s_suppkey").alias("target")), "k")
    e = op.admitted(edges(spark, sf_dir), ["part_of", "located_in"])
    return op.shortest_paths(e, pairs, 4).select("source", "target", "hops", F.concat_ws(" ", "path").alias("path"))


@query(E + " SELECT source_id, target_id, strength FROM edges WHERE relationship = 'located_in' AND source_id IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def g5_typed_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"))
    return op.admitted(edges(spark, sf_dir), ["located_in"]).join(active, "source_id", "left_semi").select("source_id", "target_id", "strength")


@query(E + " SELECT relationship, count(*) AS n FROM edges GROUP BY relationship")
def g6_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rollup(edges(spark, sf_dir))


ACTIVE = "(SELECT 'c' || c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)"


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).filter(w).select(F.concat(F.lit(p), k).alias("node")) for t, w, p, k in (("customer", "c_acctbal >= 0", "c", "c_custkey"), ("supplier", "s_acctbal >= 0", "s", "s_suppkey"), ("nation", "true", "n", "n_nationkey"), ("region", "true", "r", "r_regionkey"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(E + f" SELECT relationship, count(*) AS n FROM edges WHERE source_id IN {ACTIVE} AND target_id IN {ACTIVE} GROUP BY relationship")
def g6_rollup_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rollup(op.induced(edges(spark, sf_dir), _active(spark, sf_dir)))


@query(E + f" SELECT source_id, target_id FROM edges WHERE source_id IN {ACTIVE} AND target_id IN {ACTIVE} AND relationship = 'lives_in'")
def g7_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.induced(op.admitted(edges(spark, sf_dir), ["lives_in"]), _active(spark, sf_dir)).select("source_id", "target_id")


@query(E + """, tr AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth, ['c' || c_custkey] AS path, NULL::DOUBLE AS total_strength FROM customer
  UNION ALL SELECT tr.start, e.target_id, depth + 1, list_append(path, e.target_id), e.strength FROM tr JOIN edges e ON e.source_id = tr.node WHERE depth < 3 AND NOT list_contains(path, e.target_id))
  SELECT start, node, depth, array_to_string(path, ' ') AS path, total_strength FROM tr WHERE depth > 0""")
def g8_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return op.traversal(edges(spark, sf_dir), start, 3).withColumn("path", F.concat_ws(" ", "path"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS k, l_returnflag AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'), m AS (SELECT e, k, min(r) AS role FROM a GROUP BY e, k),
  x AS (SELECT p.e, q.e AS other, count(*) AS n FROM m p JOIN m q ON p.k = q.k AND p.e <> q.e WHERE p.e % 20 = 0 GROUP BY ALL)
  SELECT e AS entity_id, 'memory' AS kind, k AS id, role AS note FROM m WHERE e % 20 = 0 QUALIFY row_number() OVER (PARTITION BY e ORDER BY k) <= 100
  UNION ALL (SELECT e, 'entity', other, n::VARCHAR FROM x QUALIFY row_number() OVER (PARTITION BY e ORDER BY n DESC, other) <= 50)""")
def g9_entity_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active memories of each asked entity, the lowest role winning, and the entities mentioned with it there."""
    every = members(spark, sf_dir)
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("memory_id"))
    active = spread(active, every.count(), "memory_id")  # members follow; their own shuffle would come after the join
    m = every.join(active, "memory_id", "left_semi").groupBy("entity_id", "memory_id").agg(F.min("role").alias("role"))
    of = F.col("entity_id") % 20 == 0
    asked = m.filter(of)
    memories_ = top_of(asked, ["entity_id"], [F.asc("memory_id")], 100).select("entity_id", F.lit("memory").alias("kind"), F.col("memory_id").alias("id"), F.col("role").alias("note"))
    others = top_of(op.comention(m, of), ["entity_id"], [F.desc("shared"), F.asc("other")], 50)
    return memories_.unionByName(others.select("entity_id", F.lit("entity").alias("kind"), F.col("other").alias("id"), F.col("shared").cast("string").alias("note")))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS k FROM lineitem) SELECT a.e AS entity_id, b.e AS other, count(*) AS shared FROM m a JOIN m b ON a.k = b.k AND a.e <> b.e WHERE a.e % 20 = 0 GROUP BY a.e, b.e
  QUALIFY row_number() OVER (PARTITION BY a.e ORDER BY count(*) DESC, b.e) <= 8""")
def g10_comention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most co-mentioned of each entity whose id is divisible by 20, among all entities."""
    m = members(spark, sf_dir)
    return top_of(op.comention(m, F.col("entity_id") % 20 == 0, m.count()), ["entity_id"], [F.desc("shared"), F.asc("other")], 8).drop("rank")


@query("SELECT o_orderkey AS memory_id, l_linenumber AS fragment, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 3")
def g11_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("memory_id"), F.col("l_linenumber").alias("fragment"), "l_partkey", "l_suppkey")
    return top_of(rows, ["memory_id"], [F.asc("fragment"), F.asc("l_partkey"), F.asc("l_suppkey")], 3).select("memory_id", "fragment", "l_partkey")


@query("""WITH x AS (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS t, l_returnflag AS r, round(1 - l_discount, 6) AS w FROM lineitem), o AS (SELECT s AS source_id, t AS target_id, r AS relationship, max(w) AS strength FROM x GROUP BY ALL)
  SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, arg_max(relationship, relationship) AS relationship, arg_max(strength, relationship) AS strength FROM o GROUP BY 1, 2""")
def g12_simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relationship"), F.round(1 - F.col("l_discount"), 6).alias("strength"))
    return op.simple_graph(e)  # the greatest strength of each relation, as the last of those that differ in it alone wins


@query("SELECT source AS workspace, count(*) AS memories, max(doc_id) AS latest, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def g15_workspace_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("workspace")).agg(F.count(F.lit(1)).alias("memories"), F.max("doc_id").alias("latest"), F.sum("n_chars").alias("chars"))


@query("""SELECT l_orderkey AS memory_id, count(*) || ':' || strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') || ':' || substr(sha256('[' || string_agg('[' || l_partkey || ',"' || l_returnflag || '"]', ',' ORDER BY l_partkey, l_returnflag) || ']'), 1, 16) AS token FROM lineitem GROUP BY l_orderkey""")
def g16_member_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, last time and a digest of the sorted members of each memory: equal tokens mean no change."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.struct("l_partkey", "l_returnflag").alias("m"), F.col("l_shipdate").alias("at"))
    one = lambda m: F.concat(F.lit("["), m["l_partkey"], F.lit(',"'), m["l_returnflag"], F.lit('"]'))
    held = rows.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.sort_array(F.collect_list("m")).alias("ms"))
    digest = F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("ms", one), ","), F.lit("]")), 256), 1, 16)
    return held.select("memory_id", F.concat_ws(":", F.col("n").cast("string"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), digest).alias("token"))


@query("""SELECT l_suppkey, l_partkey, count(*) FILTER (WHERE l_linestatus = 'O') AS active, round(avg(1 - l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS confidence, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0 THEN 'active' ELSE 'inactive' END AS status
  FROM lineitem GROUP BY l_suppkey, l_partkey""")
def g18_relation_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("l_linestatus") == "O"
    active = F.count_if(open_)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(active.alias("active"), F.round(F.avg(F.when(open_, 1 - F.col("l_discount"))), 6).alias("confidence"), F.when(active > 0, "active").otherwise("inactive").alias("status"))


@query(E + " SELECT DISTINCT source_id, target_id, relationship FROM edges WHERE source_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1) OR target_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def g19_batch_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    e = edges(spark, sf_dir)
    hit = e.join(wanted, e["source_id"] == wanted["node"], "left_semi").union(e.join(wanted, e["target_id"] == wanted["node"], "left_semi"))
    return hit.dropDuplicates(["source_id", "target_id", "relationship"]).select("source_id", "target_id", "relationship")
