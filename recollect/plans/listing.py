"""Listings, pages and counts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import predicates as p
from recollect.operators import listing as op
from recollect.plans.registry import query
from recollect.sources.tables import WITH, memories, table

M = "WITH " + WITH["memories"]


RECORDS = """, records AS (SELECT *, list_filter([type, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END, CASE WHEN importance > 0.5 THEN 'good' END], lambda t: t IS NOT NULL) AS tags,
  CASE WHEN n_chars > 2000 THEN 'archive' ELSE 'inbox' END AS context, CASE WHEN importance < 0.5 THEN 'u1' ELSE 'u2' END AS user_id, '{"lang":"' || coalesce(type, '') || '","size":"' || n_chars || '"}' AS metadata FROM memories)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with tags, a context, a user and JSON metadata, made of their own columns."""
    tags = F.array_compact(F.array("type", F.when(F.col("n_chars") > 500, "long").otherwise("short"), F.when(F.col("importance") > 0.5, "good")))
    context, user = F.when(F.col("n_chars") > 2000, "archive").otherwise("inbox"), F.when(F.col("importance") < 0.5, "u1").otherwise("u2")
    return memories(spark, sf_dir).withColumns({"tags": tags, "context": context, "user_id": user, "metadata": F.concat(F.lit('{"lang":"'), F.coalesce("type", F.lit("")), F.lit('","size":"'), "n_chars", F.lit('"}'))})


@query(M + RECORDS + """ SELECT id, content_hash, type, workspace, importance FROM records WHERE status = 'active' AND type IN ('en', 'fr', 'de') AND list_has_all(tags, ['long']) AND json_extract_string(metadata, '$.lang') = 'en'
  AND context = 'inbox' AND user_id = 'u2' ORDER BY id DESC LIMIT 50 OFFSET 5""")
def f1_filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = op.filters(subtypes=["en", "fr", "de"], tags=["long"], metadata={"lang": "en"}, status="active", context="inbox", user="u2")
    return op.page(_records(spark, sf_dir).filter(wanted).select("id", "content_hash", "type", "workspace", "importance"), [F.desc("id")], 50, 5)


def _request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request by id that repeats ids: the conversation of each turn."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("conv_id").alias("id"))


@query(M + " SELECT conv_id * 1000 + turn AS pos, id, content_hash, type FROM conversations JOIN memories ON conv_id = id")
def f2_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hydrate(memories(spark, sf_dir).select(F.col("id").alias("key"), "content_hash", "type"), "key", _request(spark, sf_dir))


@query("SELECT min(conv_id * 1000 + turn) AS pos, page_id AS id, any_value(url) AS url FROM conversations JOIN pages ON conv_id = page_id GROUP BY page_id")
def f3_pages_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hydrate_once(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", _request(spark, sf_dir))


@query("""SELECT l_orderkey AS source_id, o_orderstatus AS source_status, l_linenumber AS child, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS pos
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O'""")
def f4_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of every source, in order of (created_at, id), each with its parent; rows of one id by part, supplier and quantity, which the SQL leaves open."""
    live = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("source_status"))
    return live.withColumn("pos", pos).join(parents, "l_orderkey").select(F.col("l_orderkey").alias("source_id"), "source_status", F.col("l_linenumber").alias("child"), "l_partkey", "pos")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY AND event_type IN ('click', 'view')")
def f5_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts")).scalar()
    inside = F.col("ts").between(first + F.expr("interval 1 day"), first + F.expr("interval 3 days"))
    return events.filter(inside & F.col("event_type").isin("click", "view")).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, lang, substr(text, 1, 100) AS abstract, substr(text, 1, 400) AS overview FROM documents WHERE n_chars > 500")
def f6_detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("n_chars > 500").select("doc_id", "lang", F.substring("text", 1, 100).alias("abstract"), F.substring("text", 1, 400).alias("overview"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS oldest, count(*) AS copies FROM documents GROUP BY 1")
def f7_lookup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("oldest"), F.count(F.lit(1)).alias("copies"))


@query("SELECT url AS external_ref, page_id, length(html) AS n_chars FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def f8_lookup_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("external_ref"), "page_id", F.length("html").cast("long").alias("n_chars"))
    return op.first_of(rows, ["external_ref"], [F.asc("page_id")])


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-01-01') AS total
  FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def f9_list_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderdate >= '1994-01-01'")
    return op.page_and_total(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 25, 50).select("o_orderkey", "o_totalprice", "total")


@query("""WITH c AS (SELECT p_brand AS collection, count(*) AS total FROM part GROUP BY p_brand) SELECT collection, p_partkey AS item, p_retailprice AS price, total,
  (SELECT count(*) FROM c) AS collections FROM part JOIN c ON collection = p_brand QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) <= 20""")
def f10_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of each collection's items, with the number of its items and of collections."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"))
    totals = part.groupBy("collection").agg(F.count(F.lit(1)).alias("total"))
    page = op.top_of(part, ["collection"], [F.desc("item")], 20).drop("rank")
    return page.join(totals, "collection").withColumn("collections", totals.agg(F.count(F.lit(1))).scalar())


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def f11_documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey AS document_id, l_linenumber AS page_no, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def f12_pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"), "l_partkey")


@query(M + " SELECT workspace AS document_id, id, content_hash, importance FROM memories WHERE status = 'active' AND workspace = (SELECT min(source) FROM documents) ORDER BY id LIMIT 100 OFFSET 10")
def f13_memories_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live memories of one document, oldest first, a page of them."""
    wanted = table(spark, sf_dir, "documents").agg(F.min("source")).scalar()
    rows = memories(spark, sf_dir).filter((F.col("status") == "active") & (F.col("workspace") == wanted))
    return op.page(rows.select(F.col("workspace").alias("document_id"), "id", "content_hash", "importance"), [F.asc("id")], 100, 10)


@query("SELECT DISTINCT l_partkey AS page_id FROM lineitem WHERE l_returnflag = 'R'")
def f14_distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("page_id")).distinct()


@query("SELECT o_orderkey AS parent FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def f15_parents_with_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(facts, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("parent"))


THREADS = """WITH threads AS (SELECT conv_id AS thread_id, count(*) AS messages, max(turn) AS last_turn, CASE WHEN bool_or(role = 'system') THEN NULL WHEN count(*) > 6 THEN 'api' ELSE 'web' END AS scope,
  CASE WHEN count(*) = 2 THEN conv_id - 1 END AS parent_thread, coalesce(max(length(text)), 0) > 1500 AS hidden, arg_min(role, turn) AS owner FROM conversations GROUP BY conv_id)"""


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: scope, parent, hidden and owner made of their messages."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(
        F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"), F.bool_or(F.col("role") == "system").alias("has_system"), F.coalesce(F.max(F.length("text")) > 1500, F.lit(False)).alias("hidden"), F.min_by("role", "turn").alias("owner")
    )
    scope = F.when(F.col("has_system"), F.lit(None)).when(F.col("messages") > 6, "api").otherwise("web")
    return t.withColumns({"scope": scope, "parent_thread": F.when(F.col("messages") == 2, F.col("thread_id") - 1)}).drop("has_system")


@query(THREADS + " SELECT thread_id, messages, last_turn, scope FROM threads WHERE parent_thread IS NULL AND coalesce(scope, 'web') = 'web' AND NOT hidden ORDER BY thread_id DESC LIMIT 50")
def f16_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level threads of the web, no scope being the web's, without hidden ones, newest first."""
    rows = _threads(spark, sf_dir).filter(F.col("parent_thread").isNull() & (F.coalesce("scope", F.lit("web")) == "web") & ~F.col("hidden"))
    return op.page(rows.select("thread_id", "messages", "last_turn", "scope"), [F.desc("thread_id")], 50)


@query("""SELECT o_custkey AS user_id, o_orderpriority AS workspace, o_orderkey AS thread_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10""")
def f17_threads_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest threads (open orders) of each user (customer) of a tenant (segment), in all workspaces (priorities)."""
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    own = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").join(owners, "o_custkey", "left_semi")
    return op.top_of(own, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("workspace"), F.col("o_orderkey").alias("thread_id"))


@query(THREADS + """ SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IN (SELECT thread_id FROM threads WHERE owner = 'user' AND NOT hidden)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 2 AND 4""")
def f18_messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth message, by index, of each thread whose owner is a user."""
    owned = _threads(spark, sf_dir).filter("owner = 'user' and not hidden").select(F.col("thread_id").alias("conv_id"))
    rows = table(spark, sf_dir, "conversations").join(owned, "conv_id", "left_semi")
    return op.top_of(rows, ["conv_id"], [F.asc("turn")], 4).filter("rank >= 2").select("conv_id", "turn", "role", "text")


@query("""WITH t AS (SELECT user_id, min(ts) + INTERVAL 20 DAY AS expires, max(ts) AS updated, max(ts) FILTER (WHERE event_type = 'error') AS hidden, bool_or(event_type = 'purchase') AS acts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
  (SELECT 'expired' AS kind, user_id FROM t, n WHERE expires < now ORDER BY expires, user_id LIMIT 100) UNION ALL (SELECT 'idle', user_id FROM t, n WHERE updated < now - INTERVAL 6 HOUR AND acts ORDER BY updated, user_id LIMIT 100)
  UNION ALL (SELECT 'hidden', user_id FROM t, n WHERE hidden < now - INTERVAL 3 DAY ORDER BY hidden, user_id LIMIT 100)""")
def f19_idle_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads (users) past their end, idle with an action for it, or long hidden: the oldest of each kind."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    t = events.groupBy("user_id").agg((F.min("ts") + F.expr("interval 20 days")).alias("expires"), F.max("ts").alias("updated"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("hidden"), F.bool_or(F.col("event_type") == "purchase").alias("acts"))
    kinds = {"expired": ("expires", F.col("expires") < now), "idle": ("updated", (F.col("updated") < now - F.expr("interval 6 hours")) & F.col("acts")), "hidden": ("hidden", F.col("hidden") < now - F.expr("interval 3 days"))}
    parts = [op.page(t.filter(rule), [F.asc(at), F.asc("user_id")], 100).select(F.lit(kind).alias("kind"), "user_id") for kind, (at, rule) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: kind, table, id, workspace, content of each listing.
ADMIN = [
    ("memory", "documents", "doc_id", "source", "text"), ("document", "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), ("page", "pages", "page_id", "'web'", "url"),
    ("dataset", "part", "p_partkey", "p_brand", "p_name"), ("job", "customer", "c_custkey", "c_mktsegment", "c_name"), ("entity", "supplier", "s_suppkey", "'shared'", "s_name"),
    ("relation", "nation", "n_nationkey", "'shared'", "n_name"), ("audit", "events", "event_id", "event_type", "props"), ("item", "benchmark", "item_id", "'shared'", "text"),
]


@query(" UNION ALL ".join(f"(SELECT '{kind}' AS kind, {key}::BIGINT AS id, {space} AS workspace, substr({content}, 1, 200) AS preview, (SELECT count(*) FROM {name}) AS total FROM {name} ORDER BY {key} DESC LIMIT 50)" for kind, name, key, space, content in ADMIN))
def f20_admin_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine kinds of rows across workspaces: the newest of each, its content's beginning, and the kind's total."""
    out = None
    for kind, name, key, space, content in ADMIN:
        rows = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.expr(space).alias("workspace"), F.substring(content, 1, 200).alias("preview"))
        page = op.page_and_total(rows, [F.desc("id")], 50)
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def f21_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return op.page(rows, [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "user_id", "value")


@query("""SELECT page_id, url FROM pages WHERE regexp_extract(split_part(url, '/', 3), '[^.]+$') IN ('com', 'org', 'net') AND regexp_extract(split_part(url, '/', 3), '[^.]+$') NOT IN ('net') AND split_part(url, ':', 1) = 'https' AND starts_with(url, 'https://m')
  ORDER BY url, page_id LIMIT 100""")
def f22_vfs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one connector (scheme) and of allowed groups (domains), denied ones out, under a literal prefix."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit(":"), F.lit(1)).alias("connector"), F.regexp_extract(F.split_part("url", F.lit("/"), F.lit(3)), "[^.]+$", 0).alias("group"))
    kept = rows.filter(op.vfs("connector", "https", "group", ["com", "org", "net"], ["net"], "url", "https://m"))
    return op.page(kept.select("page_id", "url"), [F.asc("url"), F.asc("page_id")], 100)


@query("""WITH t AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS tags FROM conversations GROUP BY conv_id)
  SELECT conv_id, list_contains(tags, 'system') AND list_contains(tags, 'user') AS has_all, list_contains(tags, 'system') OR list_contains(tags, 'tool') AS has_any FROM t""")
def f25_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("tags"))
    return tags.select("conv_id", p.tags_all(F.col("tags"), ["system", "user"]).alias("has_all"), p.tags_any(F.col("tags"), ["system", "tool"]).alias("has_any"))


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def f26_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(p.json_contains(F.col("props"), {"k": "7"})).select("event_id", "user_id")


@query("""WITH d AS (SELECT doc_id, source, max(doc_id) OVER w AS newer, arg_max(source, doc_id) OVER w AS newer_source FROM documents WINDOW w AS (PARTITION BY sha256(text)))
  SELECT doc_id AS a, newer AS b FROM d WHERE doc_id <> newer AND source <> newer_source ORDER BY newer DESC, doc_id DESC LIMIT 100""")
def f26_pending_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text in two sources contradict each other; those of one source are resolved. The newest pending."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    newest = docs.groupBy("h").agg(F.max_by(F.struct("doc_id", "source"), "doc_id").alias("n"))
    pairs = docs.join(newest, "h").filter("doc_id <> n.doc_id").select(F.col("doc_id").alias("a"), F.col("n.doc_id").alias("b"), F.when(F.col("source") == F.col("n.source"), F.lit(1)).alias("resolved_at"), "source", F.col("n.source").alias("other"))
    pending = pairs.filter("resolved_at is null and source is not null and other is not null").select("a", "b")
    return op.page(pending, [F.desc("b"), F.desc("a")], 100)


ACCESS = """, access AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id),
  seen AS (SELECT m.*, coalesce(a.n, 0) AS access_count, a.last FROM memories m LEFT JOIN access a ON m.id = a.user_id)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with how often, and when last, the user of that id was active."""
    access = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return memories(spark, sf_dir).join(access, "id", "left").withColumn("access_count", F.coalesce("n", F.lit(0)))


@query("SELECT o_orderkey AS id, o_totalprice AS importance FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY AND o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P'")
def f27_decay_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live memories (orders) over an age that aren't pinned (urgent)."""
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < orders.agg(F.max("o_orderdate") - F.expr("interval 90 days")).scalar()
    return orders.filter(old & (F.col("o_orderpriority") != "1-URGENT") & (F.col("o_orderstatus") != "P")).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("importance"))


@query(M + ACCESS + """ SELECT id, importance, access_count FROM seen WHERE importance <= 0.3 AND access_count <= 5 AND (last IS NULL OR last < (SELECT max(ts) FROM events) - INTERVAL 2 DAY) AND status = 'active' AND id IN (SELECT vec_id FROM embeddings)
  ORDER BY importance, access_count, id LIMIT 100""")
def f28_archival_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unimportant, seldom and not lately seen, embedded, not archived yet."""
    since = table(spark, sf_dir, "events").agg(F.max("ts") - F.expr("interval 2 days")).scalar()
    rows = _seen(spark, sf_dir).filter((F.col("importance") <= 0.3) & (F.col("access_count") <= 5) & (F.col("status") == "active") & (F.col("last").isNull() | (F.col("last") < since)))
    rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return op.page(rows, [F.asc("importance"), F.asc("access_count"), F.asc("id")], 100).select("id", "importance", "access_count")


@query(M + ACCESS + " SELECT id, access_count FROM seen WHERE access_count >= 5 ORDER BY access_count DESC, id LIMIT 100")
def f29_promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(_seen(spark, sf_dir).filter("access_count >= 5"), [F.desc("access_count"), F.asc("id")], 100).select("id", "access_count")
