"""Dataset slices and profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import datasets as op
from recollect.plans.registry import query
from recollect.sources.tables import table


@query("""SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity >= 40 AND l_returnflag IN ('A', 'R')) AS total
  FROM lineitem WHERE l_quantity >= 40 AND l_returnflag IN ('A', 'R') ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100""")
def d1_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [("l_quantity", ">=", 40), ("l_returnflag", "in", ["A", "R"])]
    return op.slice_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], filters, "l_extendedprice", True, 100)


D2 = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM {} WHERE l_shipdate >= TIMESTAMP '1993-01-01 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@query(D2.format("lineitem"))
def d2_raw_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slice_sql(table(spark, sf_dir, "lineitem"), D2.format("data"))


CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {} GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@query(CUBE.format("orders"))
def d2_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slice_sql(table(spark, sf_dir, "orders"), CUBE.format("data"))


FRAME = """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank FROM {}"""


@query(FRAME.format("orders"))
def d2_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slice_sql(table(spark, sf_dir, "orders"), FRAME.format("data")).withColumn("price_rank", F.col("price_rank").cast("long"))


SETS = "SELECT o_custkey AS k FROM {0} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {0} WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM {0} WHERE o_orderstatus = 'P'"


@query(SETS.format("orders"))
def d2_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.slice_sql(table(spark, sf_dir, "orders"), SETS.format("data"))


@query("SELECT count(*) AS total_matching FROM events WHERE value > 50 AND event_type <> 'view'")
def d3_total_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [("value", ">", 50), ("event_type", "!=", "view")]
    return op.total_matching(table(spark, sf_dir, "events"), filters)


def _each(columns: list[str], one: str) -> str:
    return " UNION ALL ".join(one.format(c=c) for c in columns)


LABELLED = "(SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
NULLS = "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS percent, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique FROM " + LABELLED


@query(_each(["doc_id", "lang", "source", "quality", "toxic"], NULLS))
def d6_d7_nulls_and_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return op.null_profile(rows.select("doc_id", "lang", "source", "quality", "toxic"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query(_each(NUMBERS, "SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem"))
def d8_d9_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.numeric_profile(table(spark, sf_dir, "lineitem"), NUMBERS, 4)


@query(_each(NUMBERS, "SELECT '{c}' AS \"column\", q, list_sort(list({c}::DOUBLE))[floor((count({c}) - 1) * q + 0.5)::BIGINT + 1] AS value FROM lineitem, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(q) GROUP BY q"))
def d8_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quantiles(table(spark, sf_dir, "lineitem"), NUMBERS, [0.25, 0.5, 0.75])


@query("""WITH b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)
  SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 20), 6) AS low, round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 20), 6) AS high, count(*) AS n FROM lineitem, b GROUP BY 1""")
def d10_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


KINDS = ["o_orderstatus", "o_orderpriority"]


@query(_each(KINDS, "(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2)::DOUBLE AS percent FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 20)"))
def d11_d12_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_values(table(spark, sf_dir, "orders").select(*KINDS, F.col("o_orderkey").cast("string").alias("key")), [*KINDS, "key"])


@query(_each(["p_name", "p_brand", "p_type"], "SELECT '{c}' AS \"column\", min(length({c})) AS shortest, max(length({c})) AS longest, round(avg(length({c})), 2) AS mean_length FROM part"))
def d13_string_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.string_lengths(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("""WITH t AS (SELECT DISTINCT ts FROM events), g AS (SELECT epoch_us(lead(ts) OVER (ORDER BY ts)) - epoch_us(ts) AS gap FROM t), m AS (SELECT quantile_cont(gap, 0.5) / 1e6 AS s FROM g)
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
    (SELECT CASE WHEN s < 1 THEN 'subsecond' WHEN s < 60 THEN 'second' WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 604800 THEN 'day' WHEN s < 2592000 THEN 'week' WHEN s < 31536000 THEN 'month' ELSE 'year' END FROM m) AS resolution FROM events""")
def d14_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.temporal_resolution(table(spark, sf_dir, "events"), "ts")


@query("""SELECT 'day' AS "column", avg((try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL)::INT) > 0.5 AS is_date FROM orders
  UNION ALL SELECT 'o_orderpriority', avg((try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL)::INT) > 0.5 FROM orders""")
def d15_dates_in_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return op.dates_in_strings(rows, ["day", "o_orderpriority"])


SUMMED = ["l_orderkey", *NUMBERS]
SUMMARIES = _each(
    SUMMED,
    """SELECT '{c}' AS "column", format('In dataset ''lineitem'', column ''{c}'' ({{}} type): Has {{}} unique values. Range: {{:.2f}} to {{:.2f}}. Mean: {{:.2f}}, Median: {{:.2f}}, Std: {{:.2f}}. 25th percentile: {{:.2f}}, 75th percentile: {{:.2f}}.',
  CASE WHEN any_value(typeof({c})) IN ('DOUBLE', 'FLOAT') THEN 'float' ELSE 'integer' END, count(DISTINCT {c}), min({c})::DOUBLE, max({c})::DOUBLE, round(avg({c}), 6), list_sort(list({c}::DOUBLE))[floor((count({c}) - 1) * 0.5 + 0.5)::BIGINT + 1], round(stddev_samp({c}), 6),
  list_sort(list({c}::DOUBLE))[floor((count({c}) - 1) * 0.25 + 0.5)::BIGINT + 1], list_sort(list({c}::DOUBLE))[floor((count({c}) - 1) * 0.75 + 0.5)::BIGINT + 1]) AS summary FROM lineitem""",
) + """ UNION ALL SELECT 'l_shipdate', 'In dataset ''lineitem'', column ''l_shipdate'' (datetime type): Has ' || count(DISTINCT l_shipdate) || ' unique values. Temporal column spanning ' || strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') || '.' FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'In dataset ''lineitem'', column ''l_returnflag'' (string type): Has ' || count(*) || ' unique values. Top values: ' || string_agg(t, ', ' ORDER BY n DESC, l_returnflag) || '.' FROM (SELECT l_returnflag, count(*) AS n, format('''{}'' ({}, {:.1f}%)', l_returnflag, count(*), round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM lineitem), 2)) AS t FROM lineitem GROUP BY l_returnflag)"""


@query(SUMMARIES)
def d17_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile says of each column, all rows counted."""
    return op.summaries(table(spark, sf_dir, "lineitem").select(*SUMMED, "l_shipdate", "l_returnflag"), "lineitem")


ASKED = "CASE user_id % 4 WHEN 0 THEN 'select ' WHEN 1 THEN ' SELECT ' WHEN 2 THEN 'EXPLAIN SELECT ' ELSE 'with x as ' END || event_type || ' from data where k = ' || props || CASE event_type WHEN 'error' THEN '; drop table data' WHEN 'click' THEN ' -- update' ELSE ';' END"
REFUSED = " ".join(f"WHEN regexp_matches(upper(t), '\\b{w}\\b') THEN '{w}'" for w in op.CHANGING)


@query("WITH s AS (SELECT event_id, " + ASKED + " AS s FROM events), t AS (SELECT event_id, regexp_replace(trim(s), ';+$', '') AS t FROM s), r AS (SELECT *, CASE " + REFUSED + " WHEN NOT starts_with(upper(t), 'SELECT') THEN 'SELECT' END AS refused FROM t) SELECT event_id, refused, CASE WHEN refused IS NULL THEN t END AS statement FROM r")
def d4_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many requests a dataset would be asked with, and why the others are refused."""
    refused, statement = op.statements(F.expr(ASKED))
    return table(spark, sf_dir, "events").select("event_id", refused.alias("refused"), statement.alias("statement"))
