"""Change logs, sessions, rate windows, versions and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators import sessions as op
from recollect.operators import datasets, versions
from recollect.operators.graph import descendants
from recollect.plans.registry import query
from recollect.sources import connector, formats
from recollect.sources.tables import operations, table


@query("SELECT event_id AS sequence, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def t1_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.filter(F.col("ts") >= events.agg(F.max("ts") - F.expr("interval 12 hours")).scalar()).select(F.col("event_id").alias("sequence"), "user_id")


LOG = "WITH log AS (SELECT event_id AS sequence, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS session, event_type FROM events) "


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.when(F.col("event_type") != "view", F.col("user_id")).alias("session"), "event_type")


@query(LOG + "SELECT sequence, event_type FROM log WHERE (session = 3 OR session IS NULL) AND sequence > 100 ORDER BY sequence LIMIT 200")
def t2_delta_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.delta(_log(spark, sf_dir), 3, 100, 200).select("sequence", "event_type")


@query(LOG + "SELECT session, min(sequence) AS low, max(sequence) AS high, count(*) AS n FROM log GROUP BY session")
def t3_cursor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("session").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS session, min(ts) + INTERVAL 20 DAY >= (SELECT max(ts) FROM events) AS active FROM events GROUP BY user_id")
def t4_session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    started = events.groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("started"))
    return started.select("session", (F.col("started") + F.expr("interval 20 days") >= now).alias("active"))


@query("""SELECT user_id AS session, event_type AS key, arg_max(value, event_id) AS value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 DAY >= (SELECT max(ts) FROM events)) GROUP BY ALL""")
def t5_working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key, hidden once its session is past its end, a day after its last write."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    alive = events.groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("last")).filter(F.col("last") + F.expr("interval 1 day") >= now)
    writes = events.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("sequence"))
    return op.working_memory(writes).join(alive, "session", "left_semi")


@query("SELECT sha256(user_id || chr(0) || event_type) AS id, count(*) AS copies, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY 1")
def t6_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.checkpoints(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.col("props").alias("content")))


@query("WITH c AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, bucket, n, least(n, 2) AS allowed, n - least(n, 2) AS refused FROM c")
def t7_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rate_windows(table(spark, sf_dir, "events"), 2)


@query("""WITH p AS (SELECT '/api/' || event_type || CASE WHEN value > 20 THEN '/' || user_id ELSE 's' END AS path, ts FROM events)
  SELECT path, floor(epoch(ts) / 300)::BIGINT AS bucket, count(*) AS n FROM p WHERE path = '/api/click' OR starts_with(path, '/api/click/') OR path = '/api/view' OR starts_with(path, '/api/view/') GROUP BY ALL""")
def t8_probe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under two prefixes, which end where a segment of the path does: "/api/clicks" is under none."""
    path = F.concat(F.lit("/api/"), "event_type", F.when(F.col("value") > 20, F.concat(F.lit("/"), "user_id")).otherwise("s"), F.lit("?id="), "event_id")
    return op.probe_rollup(table(spark, sf_dir, "events"), path, prefixes=["/api/click", "/api/view"])


@query("""WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS k FROM events GROUP BY ALL), o AS (SELECT user_id, day, (sum(k) OVER w)::BIGINT AS new, (sum(k) OVER w)::BIGINT - k AS old FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day))
  SELECT user_id, day, old, new FROM o WHERE (old < 1 AND new >= 1) OR (old < 5 AND new >= 5) OR (old < 10 AND new >= 10) OR new // 10 > old // 10""")
def t10_checkpoint_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    new = F.sum("k").over(Window.partitionBy("user_id").orderBy("day"))
    return op.crossings(days.withColumn("new", new).withColumn("old", F.col("new") - F.col("k")).drop("k"))


@query("SELECT user_id, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def t12_store_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of a store that stay: within their time to live, and of those the newest 20 an owner."""
    events = table(spark, sf_dir, "events")
    live = events.filter(F.col("ts") >= events.agg(F.max("ts") - F.expr("interval 10 days")).scalar())
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return live.withColumn("n", n).filter("n <= 20").select("user_id", "event_id")


@query("""WITH t AS (SELECT *, floor(epoch(ts))::BIGINT AS at_s FROM events), g AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s, event_id) >= 7200 THEN 1 ELSE 0 END AS new FROM t),
  s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY at_s, event_id))::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(at_s) AS first, max(at_s) AS last FROM s GROUP BY user_id, session""")
def t14_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gap_sessions(table(spark, sf_dir, "events"), 7200)


KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END"
FOLD = f"""WITH o AS (SELECT user_id AS resource_id, event_id AS sequence, {KIND} AS op, value FROM events),
  b AS (SELECT *, coalesce(last_value(CASE op WHEN 'create' THEN 1 WHEN 'delete' THEN 0 END IGNORE NULLS) OVER (PARTITION BY resource_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alive FROM o),
  f AS (SELECT resource_id, sequence, op, value, row_number() OVER (PARTITION BY resource_id ORDER BY sequence) AS revision FROM b WHERE CASE WHEN op = 'create' THEN alive = 0 ELSE alive = 1 END)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("op") == "signup", "create").when(F.col("op") == "error", "delete").otherwise("update")
    return versions.fold(operations(spark, sf_dir).withColumn("op", kind).drop("ts"))


@query(FOLD + " SELECT resource_id, sequence, op, revision FROM f")
def m1_versioned_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("resource_id", "sequence", "op", "revision")


@query(FOLD + " SELECT resource_id, arg_max(sequence, revision) AS sequence, arg_max(op, revision) AS op, max(revision) AS revision FROM f GROUP BY resource_id")
def m2_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.heads(_folded(spark, sf_dir).drop("value"), "resource_id", "revision")


@query(FOLD + " SELECT resource_id, 'vr-' || revision || '-' || substr(sha256(sequence || ':' || op), 1, 16) AS etag FROM f")
def m3_etags(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat_ws(":", F.col("sequence").cast("string"), "op")
    return _folded(spark, sf_dir).select("resource_id", versions.etag(F.col("revision"), content).alias("etag"))


@query("SELECT doc_id AS id, coalesce(c.n, d.n_chars) AS size, CASE WHEN c.n IS NULL THEN 'kept' ELSE 'changed' END AS state FROM documents d FULL JOIN (SELECT conv_id, sum(length(text))::BIGINT AS n FROM conversations GROUP BY 1) c ON conv_id = doc_id WHERE doc_id IS NOT NULL UNION ALL SELECT conv_id, sum(length(text))::BIGINT, 'changed' FROM conversations ANTI JOIN documents ON doc_id = conv_id GROUP BY conv_id")
def m5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.lit("kept").alias("state"))
    changes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sum(F.length("text")).alias("size")).withColumn("state", F.lit("changed"))
    return versions.upsert(current, changes, ["id"])


@query("SELECT doc_id AS id, lang, coalesce(toxic, 0) = 1 AS deleted FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0")
def m6_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard deletes are gone, soft ones marked."""
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").join(labels.filter("quality = 0"), "doc_id", "left_anti").join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), "lang", (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"))


@query("SELECT p_partkey AS id, greatest(p_size, coalesce(m, 0))::BIGINT AS updated FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber) * 10 AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def m7_touch_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_linenumber") * 10).alias("m"))
    return table(spark, sf_dir, "part").join(touched, "p_partkey", "left").select(F.col("p_partkey").alias("id"), F.greatest("p_size", F.coalesce("m", F.lit(0))).cast("long").alias("updated"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT conv_id AS id, 0 AS depth FROM conversations WHERE role = 'system' UNION SELECT c.conv_id, d.depth + 1 FROM d JOIN (SELECT DISTINCT conv_id, conv_id // 2 AS parent FROM conversations WHERE conv_id > 0) c ON c.parent = d.id WHERE d.depth < 12)
  SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id NOT IN (SELECT id FROM d)""")
def m8_recursive_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that stay when those with a system turn, and all below them, are deleted."""
    rows = table(spark, sf_dir, "conversations")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    parents = ids.filter("id > 0").select(F.floor(F.col("id") / 2).alias("source_id"), F.col("id").alias("target_id"))
    gone = descendants(parents, rows.filter("role = 'system'").select(F.col("conv_id").alias("node")))
    return ids.join(gone.withColumnRenamed("node", "id"), "id", "left_anti")


@query("SELECT user_id AS id, count(*) AS reads, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_read FROM events WHERE event_type = 'view' GROUP BY user_id")
def m10_access_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("reads"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_read"))


@query("SELECT url AS source_path, sha256(html) AS content_hash, 'text/html' AS content_type, octet_length(encode(html)) AS size_bytes FROM pages")
def s10_web_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), F.sha2("html", 256).alias("content_hash"), F.lit("text/html").alias("content_type"), F.octet_length("html").cast("long").alias("size_bytes"))


FETCHED = "SELECT url, CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 7 THEN 204 ELSE 200 END AS status, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' application/xhtml+xml ;q=1' END AS content_type, CASE WHEN page_id % 20 <> 11 THEN html END AS body FROM {}"


@query("SELECT url AS source_path, sha256(body) AS content_hash, trim(split_part(coalesce(content_type, 'text/html'), ';', 1)) AS content_type, octet_length(encode(body)) AS size_bytes, '{\"status_code\":' || status || ',\"url\":\"' || url || '\"}' AS metadata FROM (" + FETCHED.format("pages") + ") WHERE status BETWEEN 200 AND 299 AND body IS NOT NULL")
def s10_fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as entries: failed ones left out, the charset taken off the type."""
    fields = FETCHED.removeprefix("SELECT ").removesuffix(" FROM {}")
    status, kind, body = (fields[fields.index(a) : fields.index(b) + len(b)] for a, b in (("CASE WHEN page_id % 10", "AS status"), ("CASE page_id", "AS content_type"), ("CASE WHEN page_id % 20", "AS body")))
    return formats.scraped(table(spark, sf_dir, "pages").selectExpr("url", status, kind, body))


@query("""SELECT conv_id, sha256(max(CASE WHEN turn = t0 THEN text END) || CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || '--- Thread Replies ---' || chr(10) || string_agg(CASE WHEN turn > t0 THEN text END, chr(10) ORDER BY turn) ELSE '' END) AS content_hash
  FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations) GROUP BY conv_id""")
def s11_threads_as_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("ts"))
    replies = F.when(F.size("ts") > 1, F.concat(F.lit("\n\n--- Thread Replies ---\n"), F.array_join(F.slice("ts", F.lit(2), F.size("ts")), "\n"))).otherwise("")
    return rows.select("conv_id", F.sha2(F.concat(F.element_at("ts", 1), replies), 256).alias("content_hash"))


@query("""WITH p AS (SELECT source, sha256(text) AS h, min(doc_id) AS id, count(*) AS discovered FROM documents GROUP BY ALL), c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'de')
  SELECT source AS workspace, sum(discovered)::BIGINT AS discovered, count(*) FILTER (WHERE h NOT IN (FROM c)) AS synced FROM p GROUP BY source""")
def s16_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each workspace's documents, those new to the catalog and first of their content."""
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"), "lang")
    known = docs.filter("lang = 'de'").select("h", F.lit(True).alias("known")).distinct()
    polled = docs.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).join(known, "h", "left")
    return polled.groupBy(F.col("source").alias("workspace")).agg(F.sum("n").alias("discovered"), F.count_if(F.col("known").isNull()).alias("synced"))


@query("""WITH t AS (SELECT vec_id // 5 AS memory_id, vec_id % 5 AS token_index, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT DISTINCT doc_id AS memory_id FROM labels WHERE quality = 1)
  SELECT memory_id, token_index, len(e) AS size, round(CASE WHEN memory_id IN (FROM g) THEN -1 ELSE 1 END * list_sum(e), 5) + 0.0 AS total FROM t""")
def s20_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token index after new vectors of some memories (the old ones reversed) took the place of the held ones: one row a token."""
    vectors = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("memory_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))["embedding"].alias("vectors"))
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id"))
    new = vectors.join(wanted, "memory_id", "left_semi").withColumn("vectors", F.transform("vectors", lambda v: F.transform(v, lambda x: -x)))
    flat = lambda rows: rows.select("memory_id", F.posexplode("vectors").alias("token_index", "e"))
    index = versions.upsert(flat(vectors), flat(new), ["memory_id", "token_index"])
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return index.select("memory_id", F.col("token_index").cast("long").alias("token_index"), F.size("e").cast("long").alias("size"), (F.round(total, 5) + 0.0).alias("total"))


@query("SELECT conv_id, turn, coalesce(m, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_index, replace(text, chr(0), '') AS text FROM conversations LEFT JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY 1) ON user_id = conv_id")
def s21_message_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended after the events that a thread of that id has already."""
    held = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("m"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").join(held, "conv_id", "left")
    return rows.select("conv_id", "turn", (F.coalesce("m", F.lit(0)) + n - 1).alias("message_index"), F.replace("text", F.lit("\x00"), F.lit("")).alias("text"))


@query("SELECT l_returnflag AS type, count(*) AS n, count(DISTINCT l_orderkey) AS memories FROM lineitem GROUP BY l_returnflag")
def a1_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("memories"))


@query("SELECT p_partkey, (['pdf', 'markdown', 'markdown', 'text', 'text', 'html', 'html', 'docx', 'pptx', NULL])[p_size % 10 + 1] AS type FROM part")
def s6_type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document type that a file's name tells, null if none."""
    suffixes = F.array(*map(F.lit, ["pdf", "MD", "markdown", "txt", "text", "html", "Htm", "docx", "PPTX", "exe"]))
    name = F.concat(F.lit("report."), "p_partkey", F.lit("."), F.element_at(suffixes, (F.col("p_size") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", formats.kind(name, formats.DOCUMENTS).alias("type"))


@query("""SELECT item_id AS id, sha256(text) AS content_hash, 'note' AS type, 0.5::DOUBLE AS importance, 'active' AS status, 1 AS revision FROM benchmark WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)
  UNION ALL SELECT doc_id, sha256(text), lang, 0.5, 'active', 1 FROM documents""")
def s19_memory_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes (benchmark items) appended to memories (documents): hashed, with defaults, as revision 1; known contents aren't."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("type"))
    new = table(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return versions.append_memories(versions.with_defaults(held), new)


@query("""SELECT 'document' AS kind, o_orderkey::BIGINT AS id, 'pending' AS status, o_custkey::BIGINT AS parent FROM orders UNION ALL SELECT 'page', l_orderkey * 10 + l_linenumber, 'pending', l_orderkey FROM lineitem
  UNION ALL SELECT 'dataset', p_partkey, 'ready', NULL FROM part UNION ALL SELECT 'job', c_custkey, 'queued', NULL FROM customer""")
def s22_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are inserted for documents, pages, datasets and jobs, each with its kind's first status."""
    rows = {"document": ("orders", "o_orderkey", "o_custkey", "pending"), "page": ("lineitem", "l_orderkey * 10 + l_linenumber", "l_orderkey", "pending"), "dataset": ("part", "p_partkey", "null", "ready"), "job": ("customer", "c_custkey", "null", "queued")}
    out = None
    for kind, (name, key, parent, status) in rows.items():
        new = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.expr(key).cast("long").alias("id"), F.lit(status).alias("status"), F.expr(parent).cast("long").alias("parent"))
        out = new if out is None else out.unionByName(new)
    return out


@query("""WITH e AS (SELECT url AS source_path, arg_max(sha256(html), page_id) AS content_hash, count(*) AS versions FROM pages GROUP BY url), d AS (SELECT sha256(text) AS content_hash, min(doc_id) AS document_id FROM documents GROUP BY 1)
  SELECT source_path, content_hash, versions, document_id FROM e LEFT JOIN d USING (content_hash)""")
def s23_vfs_register_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries registered by path, the last content counting, and linked to the document of that content."""
    seen = table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), F.sha2("html", 256).alias("content_hash"), F.col("page_id").alias("sequence"))
    entries = seen.groupBy("source_path").agg(F.max_by("content_hash", "sequence").alias("content_hash"), F.count(F.lit(1)).alias("versions"))
    documents = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("document_id"))
    return entries.join(documents, "content_hash", "left")


@query("""SELECT url AS source_path, sha256(html) AS content_hash, 'text/html' AS content_type, octet_length(encode(html))::BIGINT AS size_bytes, 'blobs/' || sha256(html) AS blob_key, '{"page":' || page_id || '}' AS metadata FROM pages""")
def s7_connector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a connector's poll gives of each file: the columns of its contract."""
    digest = F.sha2("html", 256)
    return table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), digest.alias("content_hash"), F.lit("text/html").alias("content_type"), F.octet_length("html").cast("long").alias("size_bytes"), F.concat(F.lit("blobs/"), digest).alias("blob_key"), F.concat(F.lit('{"page":'), "page_id", F.lit("}")).alias("metadata"))


@query("""SELECT url AS source_path, sha256(html) AS content_hash, 'text/html' AS content_type, octet_length(encode(html))::BIGINT AS size_bytes, 'blobs/' || sha256(html) AS blob_key, '{"page":' || page_id || '}' AS metadata FROM pages""")
def s7_connector_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the connector as a data source, which polls the folder itself."""
    return connector.register(spark).read.format("page_connector").load(f"{sf_dir}/pages.parquet")


@query("SELECT p_partkey, regexp_full_match(p_name, '[\\w\\s\\-.]+') AS is_identifier, CASE WHEN regexp_full_match(p_name, '[\\w\\s\\-.]+') THEN '\"' || p_name || '\"' END AS quoted FROM part")
def d5_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may stand in a statement, quoted."""
    good, quoted = datasets.identifiers(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", good.alias("is_identifier"), quoted.alias("quoted"))


def _mutations(events: str) -> str:
    """SQL of ``versions.mutate`` over ``_writers`` of ``events`` (r, s, kind, x), one row after the other."""
    return f"""WITH RECURSIVE e AS ({events}), w AS (
    SELECT *, sum(CASE WHEN kind <> 'again' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS n FROM e
  ), good AS (
    SELECT r, n, s, kind, lag(kind) OVER (PARTITION BY r ORDER BY s) AS before, lag(kind || ':' || s) OVER (PARTITION BY r ORDER BY s) AS seen, lag(kind || ':' || s, 2) OVER (PARTITION BY r ORDER BY s) AS stale FROM w WHERE kind <> 'again'
  ), log AS (
    SELECT w.r, w.s, 'op-' || coalesce(g.s, w.s) AS id, CASE WHEN w.kind = 'again' AND w.x >= 40 THEN 'other' ELSE 'h' || coalesce(g.s, w.s) END AS hash,
      CASE WHEN w.n <= 1 THEN 'create' WHEN w.x >= 50 AND w.kind <> 'again' THEN 'replace' WHEN g.before = 'drop' THEN 'restore' WHEN g.kind = 'drop' THEN 'delete' ELSE 'replace' END AS action,
      CASE WHEN w.n <= 1 THEN CASE WHEN w.x < 90 THEN '*' END WHEN w.x >= 60 AND w.n > 2 THEN 'vr-' || (w.n - 2)::BIGINT || '-' || substr(sha256(stale), 1, 16) ELSE 'vr-' || (w.n - 1)::BIGINT || '-' || substr(sha256(seen), 1, 16) END AS expected,
      coalesce(g.kind, w.kind) || ':' || coalesce(g.s, w.s) AS content, CASE WHEN w.x BETWEEN 45 AND 46 THEN 'moved' ELSE 'key' END AS k
    FROM w LEFT JOIN good g ON g.r = w.r AND g.n = w.n
  ), l AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY s) AS i FROM log
  ), f AS (
    SELECT r, 0::BIGINT AS i, 0::BIGINT AS s, ''::VARCHAR AS outcome, 0::BIGINT AS revision, NULL::VARCHAR AS etag, 0::BIGINT AS rev, NULL::VARCHAR AS tag, false AS dead, NULL::VARCHAR AS key, MAP {{}}::MAP(VARCHAR, VARCHAR[]) AS ids FROM (SELECT DISTINCT r FROM l)
    UNION ALL
    SELECT r, i, s, outcome, CASE outcome WHEN 'accepted' THEN rev + 1 WHEN 'replayed' THEN ids[id][2]::BIGINT END, CASE outcome WHEN 'accepted' THEN made WHEN 'replayed' THEN ids[id][3] END,
      CASE WHEN outcome = 'accepted' THEN rev + 1 ELSE rev END, CASE WHEN outcome = 'accepted' THEN made ELSE tag END, CASE WHEN outcome = 'accepted' THEN action = 'delete' ELSE dead END, CASE WHEN outcome = 'accepted' THEN k ELSE key END,
      CASE WHEN outcome = 'accepted' THEN map_concat(ids, MAP {{id: [hash, (rev + 1)::VARCHAR, made]}}) ELSE ids END
    FROM (SELECT l.r, l.i, l.s, l.id, l.hash, l.action, l.k, f.rev, f.tag, f.dead, f.key, f.ids, 'vr-' || (f.rev + 1) || '-' || substr(sha256(l.content), 1, 16) AS made,
      CASE WHEN map_contains(f.ids, l.id) THEN CASE WHEN f.ids[l.id][1] = l.hash THEN 'replayed' ELSE 'conflict' END
        WHEN l.action = 'create' THEN CASE WHEN l.expected IS DISTINCT FROM '*' THEN 'precondition' WHEN f.rev > 0 THEN 'conflict' ELSE 'accepted' END
        WHEN f.rev = 0 THEN 'not_found' WHEN l.expected IS DISTINCT FROM f.tag THEN 'precondition'
        WHEN l.action = 'restore' AND NOT f.dead THEN 'conflict' WHEN l.action <> 'restore' AND f.dead THEN 'not_found' WHEN l.k <> f.key THEN 'conflict' ELSE 'accepted' END AS outcome
      FROM f JOIN l ON l.r = f.r AND l.i = f.i + 1)
  )"""


def _writers(events: DataFrame) -> DataFrame:
    """A log of mutations by writers of all sorts, from rows r, s, kind, x.

    Kinds other than ``again`` write, each having seen the write before; from some x on they have
    seen an older one, change what never changes, or are out of turn. ``again`` repeats the last
    write, or uses its id for something else.
    """
    own = Window.partitionBy("r").orderBy("s")
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    write = F.coalesce(F.col("kind") != "again", F.lit(False))
    w = events.withColumn("n", F.sum(write.cast("int")).over(own))
    w = w.withColumn("last", F.last(F.when(write, F.struct("kind", F.concat_ws(":", "kind", F.col("s").cast("string")).alias("told"))), ignorenulls=True).over(before))
    w = w.withColumn("stale", F.last(F.when(write, F.col("last.told")), ignorenulls=True).over(before))
    good = F.struct(F.col("s").alias("g_s"), F.col("kind").alias("g_kind"), F.col("last.kind").alias("before"), F.col("last.told").alias("seen"), "stale")
    rows = w.withColumn("good", F.last(F.when(write, good), ignorenulls=True).over(so_far)).select("r", "s", "kind", "x", "n", "good.*")
    at, again, n, x = F.coalesce("g_s", "s").cast("string"), F.col("kind") == "again", F.col("n"), F.col("x")
    action = F.when(n <= 1, "create").when((x >= 50) & ~again, "replace").when(F.col("before") == "drop", "restore").when(F.col("g_kind") == "drop", "delete").otherwise("replace")
    expected = F.when(n <= 1, F.when(x < 90, "*")).when((x >= 60) & (n > 2), versions.etag(n - 2, F.col("stale"))).otherwise(versions.etag(n - 1, F.col("seen")))
    return rows.select(
        F.col("r").alias("resource_id"), F.col("s").alias("sequence"), F.concat(F.lit("op-"), at).alias("operation_id"), F.when(again & (x >= 40), "other").otherwise(F.concat(F.lit("h"), at)).alias("request_hash"),
        action.alias("action"), expected.alias("expected"), F.concat(F.coalesce("g_kind", "kind"), F.lit(":"), at).alias("content"), F.when(x.between(45, 46), "moved").otherwise("key").alias("logical_key"), F.lit("one").alias("owner"),
    )


EVENT_WRITERS = "SELECT user_id AS r, event_id AS s, CASE event_type WHEN 'click' THEN 'again' WHEN 'error' THEN 'drop' ELSE event_type END AS kind, value AS x FROM events"


def _event_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "again").when(F.col("event_type") == "error", "drop").otherwise(F.col("event_type"))
    return _writers(table(spark, sf_dir, "events").select(F.col("user_id").alias("r"), F.col("event_id").alias("s"), kind.alias("kind"), F.col("value").alias("x")))


@query(_mutations(EVENT_WRITERS) + " SELECT r AS resource_id, s AS sequence, outcome, revision, etag FROM f WHERE i > 0")
def m1_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as mutations of one memory: ETags compared, operations answered again."""
    return versions.mutate(_event_writers(spark, sf_dir))


@query(_mutations(EVENT_WRITERS) + " SELECT r AS resource_id, revision, action, etag, content, dead AS deleted FROM f JOIN (SELECT r AS lr, s AS ls, action, content FROM l) ON lr = r AND ls = s WHERE outcome = 'accepted'")
def m1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision of those memories."""
    return versions.snapshots(_event_writers(spark, sf_dir)).drop("logical_key", "owner")


@query(_mutations("SELECT o_custkey AS r, o_orderkey AS s, CASE o_orderpriority WHEN '5-LOW' THEN 'again' WHEN '4-NOT SPECIFIED' THEN 'drop' ELSE o_orderpriority END AS kind, o_totalprice / 6000 AS x FROM orders") + " SELECT r AS resource_id, s AS sequence, outcome, revision, etag FROM f WHERE i > 0")
def m4_skill_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contract for skills: customers' orders, replayed by priority."""
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "again").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "drop").otherwise(F.col("o_orderpriority"))
    return versions.mutate(_writers(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("r"), F.col("o_orderkey").alias("s"), kind.alias("kind"), (F.col("o_totalprice") / 6000).alias("x"))))
