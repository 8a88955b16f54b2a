import hashlib
import math

import numpy as np
import pytest

from recollect.llm import centroids
from recollect.llm.queries import QUERIES


def brute(rows, size=64, scale=64, k=16, rounds=3):
    """vec_id, cluster, distance of each kept vector, by plain loops over all centroids."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for r in range(rounds + 1):
        to = [min(range(len(means)), key=lambda c, v=v: (far(v, means[c]), c)) for _, v in kept]
        if r < rounds:
            own = [[v for (_, v), t in zip(kept, to, strict=True) if t == c] for c in range(len(means))]
            means = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else m for o, m in zip(own, means, strict=True)]
    return sorted((str(i), t, far(v, means[t])) for (i, v), t in zip(kept, to, strict=True))


def plain(df):
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in df.collect())


@pytest.fixture(scope="module")
def some():
    near = np.random.default_rng(5)
    heaps = near.normal(size=(5, 8)) * 3
    rows = [(i, (heaps[i % 5] + near.normal(size=8)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, [0.0] * 8), (901, [0.25] * 8), (901, [0.25] * 8), (902, [9e4] + [-0.001] * 7)]
    return rows + [(903, None), (904, []), (905, [1.0] * 7), (906, [1.0] * 9), (907, [None] + [1.0] * 7), (908, [math.nan] + [1.0] * 7), (909, [math.inf] + [1.0] * 7)]


def test_whole_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    found = QUERIES["op12_centroids"](spark, small).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found) == brute(rows)
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}
    assert all(r.cluster_inertia == sum(x.distance for x in found if x.cluster == r.cluster) for r in found[:5])


@pytest.mark.parametrize("bits", [1, 4, 8])
@pytest.mark.parametrize("fetch", [0, 500_000])
def test_few_bits_and_shuffled_fetches_decide_nothing(spark, some, monkeypatch, bits, fetch):
    monkeypatch.setattr(centroids, "FETCH", fetch)
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
    found, report = centroids.cluster(df, size=8, k=6, bits=bits)
    assert plain(found) == brute(some, 8, 64, 6)
    assert all(u <= f <= len(some) for u, f in zip(report["undecided"], report["fetched"], strict=True))


def test_intervals_hold_the_distances():
    near = np.random.default_rng(1)
    v, c = near.integers(-50, 50, (400, 8)), near.integers(-50, 50, (7, 8))
    cells = centroids.Cells([(-50, 49, -40, 40)] * 8, 4)
    able = centroids.candidates(cells.of(v), cells.tables(c))
    distance = ((v[:, None] - c) ** 2).sum(2)
    assert able[np.arange(400), distance.argmin(1)].all()
    assert (able.sum(1) == 1).any()


def test_fewer_vectors_than_centroids_ties_and_huge_components(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1e30, -1e30])]
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=2)[0].collect()
    by = {r.vec_id: r for r in found}
    assert len(found) == 3 and by[1].cluster == by[2].cluster != by[3].cluster and by[3].distance == 0


def test_nothing_and_clashing_columns(spark, some):
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as cluster", "3 as cells", "4 as v")
    assert plain(centroids.cluster(df, size=8, k=6)[0]) == brute(some, 8, 64, 6)
    assert centroids.clusters(spark, df.limit(0)).collect() == []
