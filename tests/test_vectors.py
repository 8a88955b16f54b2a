"""Vector search by both ways, against plain products."""

import re
import subprocess
import sys

import numpy as np
import pytest

from recollect.operators import vectors


@pytest.fixture(scope="module")
def points():
    near = np.random.default_rng(11)
    return [(i, near.normal(size=6).round(2).tolist(), i % 3) for i in range(180)] + [(500, [0.0] * 6, 1), (501, None, 1), (502, [1.0] * 6, None), (503, [1.0] * 6, None)]


@pytest.fixture(params=["sent", "shuffled"])
def way(request, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 16)
    if request.param == "shuffled":
        monkeypatch.setattr(vectors, "BROADCAST", 0)
        monkeypatch.setattr(vectors, "BLOCK", 64 * 50)
    return request.param


def plain(points, k, groups=None):
    kept = [p for p in points if p[1] is not None]
    m = np.array([p[1] for p in kept])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    out = set()
    for i, (q, _, g) in enumerate(kept):
        if q % 10 == 0:
            sims = [(-round(float(x), 6) + 0.0, r[0]) for x, r in zip(unit @ unit[i], kept, strict=True) if r[0] != q and (groups is None or r[2] == g)]
            out |= {(q, r, n + 1) for n, (_, r) in enumerate(sorted(sims)[:k])}
    return out


SCHEMA = "id long, embedding array<double>, kind long"


def test_search(spark, points, way):
    df = spark.createDataFrame(points, SCHEMA).repartition(3)
    found = vectors.search(df, df.filter("id % 10 = 0"), 4, block=7)
    assert {(r.query_id, r.id, r.rank) for r in found.collect()} == plain(points, 4)


def test_search_among_equals(spark, points, way):
    df = spark.createDataFrame(points, SCHEMA).filter("kind is not null")
    found = vectors.search(df, df.filter("id % 10 = 0"), 3, same="kind", block=5)
    assert {(r.query_id, r.id, r.rank) for r in found.collect()} == plain([p for p in points if p[2] is not None], 3, True)


def test_links_join_what_all_pairs_join(spark, points, way):
    df = spark.createDataFrame(points, SCHEMA)
    pairs = {(r.query_id, r.id) for r in vectors.within(df, df, 0.8, block=11).collect()}
    links = {(r.src, r.dst) for r in vectors.near_links(df, 0.8, block=11).collect()}
    assert links <= pairs and all(a < b for a, b in links)

    def parts(edges):
        own = {p[0]: p[0] for p in points}

        def root(x):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in edges:
            own[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in own}

    assert parts(links) == parts(pairs)


def test_records_of_many_vectors_stay_whole(spark, way):
    near = np.random.default_rng(2)
    groups = [(i, near.normal(size=(int(near.integers(0, 30)), 4)).tolist()) for i in range(40)]
    df = spark.createDataFrame(groups, "group_id long, embeddings array<array<double>>")
    found = {(r.query_id, r.group_id): r.score for r in vectors.maxsim(df, df.filter("group_id < 9").withColumnRenamed("group_id", "id"), block=3).collect()}
    unit = {i: np.array(e) / np.linalg.norm(np.array(e), axis=1, keepdims=True) for i, e in groups if e}
    assert found.keys() == {(q, g) for q in unit for g in unit if q < 9}
    assert all(abs(s - (unit[q] @ unit[g].T).max(1).sum()) < 1e-5 for (q, g), s in found.items())


def test_rows_are_not_shuffled_to_meet_queries(spark, points):
    df = spark.createDataFrame(points, SCHEMA)
    text = vectors.within(df, df.filter("id % 10 = 0"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Join", text)


def test_executors_get_the_whole_package(tmp_path, small):
    """From a folder from which it can't be imported, without its place in the workers' path."""
    from pathlib import Path

    home = Path(vectors.__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(home)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from recollect.plans.all import QUERIES
print("rows", QUERIES["v1_cosine_topk"](spark, {small!r}).count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert re.search(r"rows [1-9]", done.stdout), done.stderr[-1500:]
