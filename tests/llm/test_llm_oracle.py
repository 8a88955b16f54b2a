"""Queries that SQL can express give the rows that DuckDB gives for them."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from recollect.llm.queries import QUERIES
from recollect.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = db.sql(SQL[name])
    place = {c: i for i, c in enumerate(found.columns)}
    assert sorted(place) == columns
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(str([r[place[c]] for c in columns]) for r in found.fetchall())


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_a_query_of_the_core_after_one_of_these(tmp_path, small):
    """From a folder from which the package can't be imported: executors get all of it; batches stay as large as they were."""
    home = Path(QUERIES["op1_main_text"].__code__.co_filename).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(home)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
from recollect.llm.queries import QUERIES
print("tokens", QUERIES["op5_token_counts"](spark, {small!r}).count())
from recollect.plans.all import QUERIES
print("rows", QUERIES["v1_cosine_topk"](spark, {small!r}).count(), before == spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert re.search(r"tokens [1-9][\s\S]*rows [1-9]\d* True", done.stdout), done.stderr[-1500:]
