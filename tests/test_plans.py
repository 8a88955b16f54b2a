"""Shapes of plans that matter at scale: what is read, what is shuffled, what never happens."""

import ast
import re
from collections import Counter
from pathlib import Path

import pytest

import recollect.plans
from recollect.plans.all import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)", text)]


@pytest.mark.parametrize(
    ("name", "columns"),
    [("f7_lookup_by_hash", {"doc_id", "text"}), ("d3_total_matching", {"event_type", "value"}), ("g18_relation_refresh", {"l_partkey", "l_suppkey", "l_discount", "l_linestatus"}), ("f14_distinct_pages", {"l_partkey", "l_returnflag"})],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    assert all(found <= columns for found in read_columns(plan(QUERIES[name](spark, small))))


@pytest.mark.parametrize(("name", "pushed"), [("f12_pages_of_documents", "EqualTo(o_orderstatus,P)"), ("f14_distinct_pages", "EqualTo(l_returnflag,R)"), ("d1_slice", "GreaterThanOrEqual(l_quantity,40.0)"), ("f21_audit", "EqualTo(event_type,error)")])
def test_filters_reach_the_scan(spark, small, name, pushed):
    assert pushed in plan(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["f1_filter_search", "f9_list_with_total", "f21_audit", "f28_archival_candidates", "p11_unified_jobs", "d1_slice"])
def test_pages_are_top_k_not_sorts(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "TakeOrderedAndProject" in text and not re.search(r"rangepartitioning", text)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_stream")))
def test_no_product_of_tables(spark, small, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, small)))


def test_no_name_is_defined_twice():
    """A second helper of one name takes the first one's place in every query above it."""
    for file in Path(recollect.plans.__path__[0]).glob("*.py"):
        names = Counter(x.name for x in ast.parse(file.read_text()).body if isinstance(x, ast.FunctionDef))
        assert [n for n, times in names.items() if times > 1] == [], file.name


def test_quotes_are_located_in_regions_found_once(spark, small):
    """The pages' HTML is read and parsed before quotes are made of it, not again for each use of its regions."""
    text = plan(QUERIES["p16_page_quotes"](spark, small))
    assert "html" not in text and "page-blocks" in text


def test_children_of_one_time_and_id_have_one_order(spark, small, tmp_path):
    """What the order of (created_at, id) leaves open is settled by the part, so runs agree."""
    spark.read.parquet(f"{small}/orders.parquet").limit(1).selectExpr("1L as o_orderkey", "o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    rows = [(1, part, 7, 1, 1.0, "O", "1998-01-01") for part in (9, 3, 5)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate string")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.l_partkey for r in QUERIES["f4_children"](spark, str(tmp_path)).orderBy("pos").collect()] == [3, 5, 9]


def test_neighbours_are_all_within_two_steps(spark, small, tmp_path):
    """A supplier has more than 50 neighbours where its nation has as many customers."""
    for name, schema, rows in (
        ("region", "r_regionkey int, r_name string", [(0, "R")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(1, 0), (2, 0)]),
        ("customer", "c_custkey long, c_nationkey int", [(i, 0) for i in range(60)]),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = QUERIES["g2_neighbours"](spark, str(tmp_path)).collect()
    near = {"n0": 1, "r0": 2} | {f"c{i}": 2 for i in range(60)}
    assert len(rows) == 128 and {(r.root, r.node): r.depth for r in rows} == {(s, n): d for s, other in (("s1", "s2"), ("s2", "s1")) for n, d in (near | {s: 0, other: 2}).items()}


def test_scores_of_documents_are_summed_where_their_postings_are(spark, small):
    """A row for each query and document that share a term is not shuffled, only what each query keeps."""
    text = plan(QUERIES["r1_bm25"](spark, small))
    assert not re.search(r"hashpartitioning\((query_id#\w+, id#|id#\w+, query_id#)", text)
