"""Documents and jobs: orders as documents, their lines as pages, customers as jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.predicates import collapse
from recollect.operators import documents as op
from recollect.plans.registry import query
from recollect.sources.shared import saved
from recollect.sources.tables import table

GAPS = """WITH g AS (SELECT l_orderkey AS document_id, count(*) AS pages, count(*) FILTER (WHERE NOT l_quantity > 2) AS not_rendered, count(*) FILTER (WHERE NOT l_tax < 0.08) AS not_transcribed,
  count(*) FILTER (WHERE NOT l_discount < 0.1) AS not_embedded, count(*) FILTER (WHERE NOT l_linestatus = 'F') AS not_stored FROM lineitem GROUP BY l_orderkey),
  d AS (SELECT *, CASE WHEN not_rendered > 0 THEN 'rendered' WHEN not_transcribed > 0 THEN 'transcribed' WHEN not_embedded > 0 THEN 'embedded' WHEN not_stored > 0 THEN 'stored' END AS first_gap FROM g)"""


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_quantity") > 2).alias("rendered"), (F.col("l_tax") < 0.08).alias("transcribed"), (F.col("l_discount") < 0.1).alias("embedded"), (F.col("l_linestatus") == "F").alias("stored"))


@query(GAPS + " SELECT *, first_gap IS NULL AS is_complete FROM d")
def p1_gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gaps(_order_pages(spark, sf_dir))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN 'off' END, json_extract_string(props, '$.mode'), CASE WHEN value > 50 THEN 'fast' END, 'default') AS mode FROM events")
def p2_flag_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_type") == "error", "off"), F.get_json_object("props", "$.mode"), F.when(F.col("value") > 50, "fast"), F.lit("default")).alias("mode"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N'")
def p3_fact_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(facts, "o_orderkey", "left_anti").select("o_orderkey")


@query("""WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag) AS due, list(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
  SELECT o_orderkey AS id, CASE WHEN due IS NULL THEN 'not_applicable' WHEN len(coalesce(open, [])) > 0 THEN 'pending' ELSE 'complete' END AS status FROM orders LEFT JOIN s ON id = o_orderkey""")
def p4_enrichment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("due"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("open"))
    status = F.when(F.col("due").isNull(), "not_applicable").when(F.size(F.array_intersect("due", "open")) > 0, "pending").otherwise("complete")
    return table(spark, sf_dir, "orders").join(due, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query(GAPS + " SELECT document_id, CASE WHEN first_gap IS NULL THEN 'completed' WHEN pages - not_stored > 0 THEN 'partial' ELSE 'failed' END AS status FROM d")
def p5_final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = op.gaps(_order_pages(spark, sf_dir))
    return g.select("document_id", op.final_status(F.col("is_complete"), F.col("pages") - F.col("not_stored")).alias("status"))


@query(GAPS + """ SELECT o_custkey AS job_id, count(*) AS requested, count(d.document_id) AS known, coalesce(sum(pages), 0)::BIGINT AS pages, bool_and(coalesce(first_gap IS NULL AND d.document_id IS NOT NULL, false)) AS all_complete
  FROM orders LEFT JOIN d ON document_id = o_orderkey GROUP BY o_custkey""")
def p6_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = op.gaps(_order_pages(spark, sf_dir))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("document_id"))
    both = asked.join(g, "document_id", "left")
    return both.groupBy("job_id").agg(F.count(F.lit(1)).alias("requested"), F.count("pages").alias("known"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.bool_and(F.coalesce("is_complete", F.lit(False))).alias("all_complete"))


@query("""SELECT l_orderkey AS document_id, l_linenumber - 1 AS page_no, CASE WHEN l_tax < 0.04 THEN 'part ' || l_partkey ELSE '[Visual page ' || l_linenumber || ' of order-' || l_orderkey || '.pdf]' END AS content FROM lineitem""")
def p7_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's transcript (a part), or what stands for it; pages count from 0."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") - 1).alias("page_no"), F.when(F.col("l_tax") < 0.04, F.concat(F.lit("part "), "l_partkey")).otherwise("").alias("transcript"))
    file = F.concat(F.lit("order-"), "document_id", F.lit(".pdf"))
    return lines.select("document_id", "page_no", op.page_text(F.col("transcript"), F.col("page_no"), file).alias("content"))


@query("SELECT DISTINCT o_custkey AS job_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity = 50")
def p9_jobs_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("job_id")).distinct()


@query("SELECT o_custkey AS job_id, count(*) AS \"references\" FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING bool_and(coalesce(done, false))")
def p10_orphaned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("document_id"))
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "completed").otherwise("processing").alias("status"))
    return op.orphaned(jobs, done)


@query("SELECT kind, id, day FROM (SELECT 'document' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL SELECT 'dataset', event_id, strftime(ts, '%Y-%m-%d') FROM events) ORDER BY day DESC, kind, id LIMIT 100")
def p11_unified_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One limit over both kinds of job."""
    docs = table(spark, sf_dir, "orders").select(F.lit("document").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    sets = table(spark, sf_dir, "events").select(F.lit("dataset").alias("kind"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return docs.unionByName(sets).orderBy(F.desc("day"), "kind", "id").limit(100)


@query("""SELECT o_orderkey AS blob FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""")
def p12_blob_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs (orders) of no live document (open line), older than the grace."""
    blobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("blob"), F.col("o_orderdate").alias("mtime"))
    live = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("blob"))
    return op.garbage(blobs, live, "blob", blobs.agg(F.max("mtime")).scalar(), "30 days").select("blob")


@query("""SELECT o_orderkey AS upload_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def p13_abandoned_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads without a hash (open orders) and a document (a large line), past the cutoff: the oldest."""
    uploads = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("mtime"))
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("upload_id"))
    now = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return op.garbage(uploads, used, "upload_id", now, "60 days").orderBy("mtime", "upload_id").limit(50).select("upload_id")


#: Grounded markup made of a page's HTML: titles, texts, notes (no label), figures, page numbers, headers, and a marker cut off.
MARKUP = [
    (r"(?i)<h[1-3]\b[^>]*>", "<|ref|>title<|/ref|> <|det|>[[10, 20, 900, 80]]<|/det|>"), (r"(?i)<p\b[^>]*>", "<|det|>text [10, 100, 900, 300]<|/det|>"), (r"(?i)<li\b[^>]*>", "<|ref|>A note <|/ref|><|det|>[5, 6, 7]<|/det|>"),
    (r"(?i)<(nav|img)\b[^>]*>", "<|ref|>Figure<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>"), (r"(?i)<footer\b[^>]*>", "<|det|>page_number [400, 950, 600, 990]<|/det|>"), (r"(?i)<header\b[^>]*>", "<|det|>header<|/det|><|end|>"), (r"(?i)<ul\b[^>]*>", "<|ref|>"), (r"(?i)</?[a-z!][^>]*>", " "),
]
_SQL_MARKUP = "html"
for _pattern, _to in MARKUP:
    _SQL_MARKUP = f"regexp_replace({_SQL_MARKUP}, '{_pattern}', '{_to}', 'g')"


def _cleaned(x: str) -> str:
    return f"trim(regexp_replace({x}, '{op.RESIDUE}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))".replace("\n]", "\\n]")


def _named(x: str) -> str:
    return f"replace(lower({_cleaned(x)}), ' ', '_')"


def _box(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({x}, '-?[0-9]+')) >= 4 THEN list_transform(regexp_extract_all({x}, '-?[0-9]+')[1:4], lambda x: x::INT) END"


REGIONS = f"""WITH m AS (SELECT page_id, {_SQL_MARKUP} AS raw FROM pages),
  s AS (SELECT page_id, string_split(regexp_replace(raw, '(?s){op.REFERRED}', chr(1) || 'R\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS l FROM m),
  t AS (SELECT page_id, unnest(l) AS seg, generate_subscripts(l, 1) AS i FROM s),
  u AS (SELECT page_id, i, i > 1 AS referred, CASE WHEN i > 1 THEN substr(split_part(split_part(seg, chr(3), 1), chr(2), 1), 2) END AS name, CASE WHEN i > 1 THEN split_part(split_part(seg, chr(3), 1), chr(2), 2) END AS ref_box,
    CASE WHEN i > 1 THEN substr(seg, strpos(seg, chr(3)) + 1) ELSE seg END AS rest FROM t),
  v AS (SELECT *, string_split(regexp_replace(regexp_replace(rest, '{op.DETECTED}', chr(1) || 'D\\1' || chr(2) || '\\2' || chr(3), 'g'), '{op.MARKER}', chr(1) || 'P<|\\1|>', 'g'), chr(1)) AS l FROM u),
  w AS (SELECT page_id, i, referred, name, ref_box, unnest(l) AS part, generate_subscripts(l, 1) AS j FROM v),
  k AS (SELECT *, referred AND {_named("name")} IN ({", ".join(f"'{x}'" for x in op.LABELS)}) AS known FROM w),
  r AS (
    SELECT page_id, i, 0 AS j, 'text' AS label, {_box("ref_box")} AS box, {_cleaned("name")} AS content FROM k WHERE referred AND NOT known AND j = 1 AND {_cleaned("name")} <> ''
    UNION ALL SELECT page_id, i, j, replace({_named("name")}, 'figure', 'image'), {_box("ref_box")}, {_cleaned("part")} FROM k WHERE known AND j = 1 AND {_named("name")} <> 'figure_title'
    UNION ALL SELECT page_id, i, j, {_named("name")}, {_box("ref_box")}, {_cleaned("part")} FROM k WHERE known AND j = 1 AND {_named("name")} = 'figure_title'
    UNION ALL SELECT page_id, i, j, 'text', NULL, {_cleaned("part")} FROM k WHERE NOT known AND j = 1 AND {_cleaned("part")} <> ''
    UNION ALL SELECT page_id, i, j, coalesce(nullif({_named("substr(split_part(part, chr(2), 1), 2)")}, ''), 'text'), {_box("split_part(split_part(part, chr(3), 1), chr(2), 2)")}, {_cleaned("substr(part, strpos(part, chr(3)) + 1)")} FROM k WHERE j > 1 AND starts_with(part, 'D')
    UNION ALL SELECT page_id, i, j, 'text', NULL, {_cleaned("substr(part, 2)")} FROM k WHERE j > 1 AND starts_with(part, 'P') AND {_cleaned("substr(part, 2)")} <> ''
  ), x AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos, label, box, content FROM r)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, found: the regions of each page's markup; pages are dealt anew, as few large row groups would be few tasks."""
    raw = F.col("html")
    for pattern, to in MARKUP:
        raw = F.regexp_replace(raw, pattern, to.replace("$", "\\$"))
    dealt = table(spark, sf_dir, "pages").select("page_id", "html").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return dealt.select("page_id", op.grounded(raw).alias("found"))


@query(REGIONS + " SELECT page_id, pos, label, box, content FROM x")
def p14_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's regions, from grounded markup with labels, boxes, unknown labels and a marker cut off."""
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode("found").alias("pos", "r"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "r.label", "r.box", "r.content")


RENDERED = """, y AS (SELECT *, sum((label = 'image')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS fig FROM x WHERE label NOT IN ('header', 'page_number')),
  z AS (SELECT page_id, pos, CASE WHEN label = 'image' THEN '[figure ' || fig || ']' || CASE WHEN content <> '' THEN chr(10) || chr(10) || content ELSE '' END WHEN content = '' THEN NULL WHEN label = 'title' THEN '## ' || content ELSE content END AS b FROM y),
  tr AS (SELECT page_id, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS text FROM z GROUP BY page_id)"""


@query(REGIONS + RENDERED + " SELECT page_id, sha256(coalesce(text, '')) AS transcript_hash FROM pages LEFT JOIN tr USING (page_id)")
def p15_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts: headings marked, figures numbered, headers and page numbers left out."""
    return _pages(spark, sf_dir).select("page_id", F.sha2(op.rendered(F.col("found")), 256).alias("transcript_hash"))


WORDS = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query(REGIONS + f""", c AS (SELECT page_id, pos, box, {WORDS} AS t FROM x WHERE {WORDS} <> ''), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, lead(t) OVER (PARTITION BY page_id ORDER BY pos) AS following, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM c),
  q AS (SELECT page_id, n, regexp_extract(t, '\\S+ \\S+$|^\\S+$') || ' ' || regexp_extract(following, '^\\S+') AS quote FROM o WHERE following IS NOT NULL), j AS (SELECT page_id, string_agg(t, ' ' ORDER BY pos) AS page FROM c GROUP BY page_id),
  f AS (SELECT q.page_id, q.n, quote, strpos(page, quote) - 1 AS at, strpos(page, quote) > 0 AND strpos(substr(page, strpos(page, quote) + 1), quote) = 0 AS once FROM q JOIN j USING (page_id)),
  h AS (SELECT f.page_id, f.n, bool_or(o.box IS NULL) AS unboxed, list(o.pos::INT ORDER BY o.pos) AS regions FROM f JOIN o ON o.page_id = f.page_id AND o.s < f.at + length(quote) AND o.s + length(o.t) > f.at WHERE once GROUP BY ALL)
  SELECT f.page_id, f.n::INT AS n, CASE WHEN once AND NOT unboxed THEN h.regions ELSE [] END AS regions FROM f LEFT JOIN h USING (page_id, n)""")
def p16_page_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that run from the end of each block of a page into the next: the regions they stand in, if nowhere else."""
    blocks = F.filter(F.transform("found", lambda r: collapse(r["content"])), lambda t: t != "")
    pages = saved(_pages(spark, sf_dir), "page-regions")  # each page is read once, not once for each use of its regions
    pages = saved(pages.select("page_id", blocks.alias("blocks"), op.placed(F.col("found")).alias("places")), "page-blocks")
    pages = pages.withColumn("page", collapse(F.array_join("blocks", " ")))
    ends = F.transform("blocks", lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"), F.get("blocks", i + 1).alias("following")))
    asked = pages.select("page_id", "page", "places", F.explode(F.filter(ends, lambda x: x["following"].isNotNull())).alias("x"))
    quote = F.concat_ws(" ", F.regexp_extract("x.t", r"\S+ \S+$|^\S+$", 0), F.regexp_extract("x.following", r"^\S+", 0))
    return op.quoted_in(asked, quote, F.col("page"), F.col("places")).select("page_id", "x.n", "regions")


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark),
  f AS (SELECT item_id, doc_id, strpos(d.t, q.t) - 1 AS begin_at, ((length(d.t) - length(replace(d.t, q.t, ''))) // length(q.t))::BIGINT AS times FROM q JOIN d ON contains(d.t, q.t))
  SELECT *, count(*) OVER (PARTITION BY item_id) = 1 AND times = 1 AS is_unique FROM f""")
def p16_quote_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes stand in documents, white space aside, how often, and whether nowhere else."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return op.locate(table(spark, sf_dir, "documents").select("doc_id", "text"), quotes)


@query("SELECT source, count(*) AS objects, sum(n_chars)::BIGINT AS apparent, round(sum(n_chars) / sum(n_chars::DOUBLE / c), 4) AS ratio FROM (SELECT *, count(*) OVER (PARTITION BY source, sha256(text)) AS c FROM documents) GROUP BY source")
def p18_storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_chars").alias("all"), F.first("n_chars").alias("one"))
    return texts.groupBy("source").agg(F.sum("c").alias("objects"), F.sum("all").alias("apparent"), F.round(F.try_divide(F.sum("all"), F.sum("one")), 4).alias("ratio"))


@query("SELECT doc_id AS key, n_chars AS size FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC) AS upto FROM documents) WHERE upto > 1000000")
def p19_cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return op.evict(files, 1_000_000).select("key", "size")


@query(GAPS + """ SELECT o_orderkey AS id, CASE WHEN d.document_id IS NULL THEN 'fresh' WHEN o_orderstatus = 'P' AND epoch(o_orderdate)::BIGINT > (SELECT max(epoch(o_orderdate))::BIGINT FROM orders) - 864000 THEN 'in_flight' WHEN o_orderstatus = 'F' THEN 'complete'
  ELSE 'resume:' || coalesce(first_gap, 'render') END AS decision FROM orders LEFT JOIN d ON d.document_id = o_orderkey""")
def p20_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = op.gaps(_order_pages(spark, sf_dir)).select(F.col("document_id").alias("o_orderkey"), "first_gap", "pages")
    status = F.when(F.col("pages").isNull(), F.lit(None)).when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "completed").otherwise("partial")
    orders = table(spark, sf_dir, "orders").withColumn("started", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    found = orders.join(g, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), status.alias("status"), "started", "first_gap")
    return op.arrivals(found, orders.agg(F.max("started")).scalar(), 864_000)
