"""Centroid clustering of vectors by a file of approximations.

Each vector is kept beside its cells, a few bits a dimension. From lookup tables over the cells
every centroid gets an interval that holds its distance; a vector whose least interval stands
alone is decided by its cells. Full vectors are fetched only for the rest, and for those that
change clusters, whose sums move with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import for_python, saved

#: Integer components beyond this are taken as this, so that distances fit in a long.
FARTHEST = 1 << 24
#: Rows of 16 bytes that may be sent to every task to fetch their full vectors; beyond it they are shuffled.
FETCH = 500_000
CELLS = "key long, vec_id long, cells binary, v array<int>"
STATE = "key long, cells binary, cluster int, sums array<long>"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x * scale))))).cast("int"))


def whole(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none null, infinite or NaN."""
    finite = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


class Cells:
    """The cells of each dimension: equal widths between two quantiles, and what lies outside.

    ``marks[d]`` are where cells begin, ``low`` and ``high`` the least and greatest value a cell
    can hold, the outermost being the least and greatest of all values.
    """

    def __init__(self, spans: list[tuple[int, int, int, int]], bits: int):
        self.marks, self.low, self.high = [], [], []
        for least, most, left, right in spans:
            marks = np.unique(np.linspace(left, right + 1, (1 << bits) - 1).astype(np.int64))
            marks = marks[(marks > least) & (marks <= most)]
            self.marks.append(marks)
            self.low.append(np.concatenate([[least], marks]))
            self.high.append(np.concatenate([marks - 1, [most]]))

    def of(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.uint8)
        for d, marks in enumerate(self.marks):
            out[:, d] = np.searchsorted(marks, v[:, d], side="right")
        return out

    def tables(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dimension, the bounds of each cell's part of the distance to each centroid.

        Less its part of the distance to the centroids' middle, which is the same for all of
        them: what is left is linear in the component, and its interval much narrower.
        """
        middle = centroids.sum(0) // len(centroids)
        out = []
        for d, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            level, slope = centroids[:, d] ** 2 - middle[d] ** 2, -2 * (centroids[:, d] - middle[d])
            a, b = level + low[:, None] * slope, level + high[:, None] * slope
            out.append((np.minimum(a, b), np.maximum(a, b)))
        return out


def candidates(cells: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which centroids can be the nearest: those whose interval begins no later than every interval ends."""
    low = np.zeros((len(cells), tables[0][0].shape[1]), np.int64)
    high = np.zeros_like(low)
    for d, (a, b) in enumerate(tables):
        low += a[cells[:, d]]
        high += b[cells[:, d]]
    return low <= high.min(1, keepdims=True)


def nearest(v: np.ndarray, able: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each vector's ``able`` centroids, and its squared distance; ties go to the smaller number."""
    best, least = np.zeros(len(v), np.int32), np.full(len(v), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        rows = np.flatnonzero(able[:, c])
        d = ((v[rows] - centroids[c]) ** 2).sum(1)
        nearer = d < least[rows]
        best[rows[nearer]], least[rows[nearer]] = c, d[nearer]
    return best, least


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _cells(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _added(v: np.ndarray, to: np.ndarray, k: int, sums: np.ndarray, sign: int = 1) -> None:
    """Adds vectors to ``sums``, a row a cluster: the sum of each component, and at the end the count."""
    for c in np.unique(to):
        own = v[to == c]
        sums[c, :-1] += sign * own.sum(0)
        sums[c, -1] += sign * len(own)


def _state(key: pa.Array, cells: pa.Array, cluster: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of STATE: the vectors, then a row with the sums of each cluster that this batch changes."""
    changed = [c for c in range(len(sums)) if sums[c].any()]
    n = len(changed)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([key, pa.nulls(n, pa.int64())]), pa.concat_arrays([cells.cast(pa.binary()), pa.nulls(n, pa.binary())]), pa.array([*cluster.tolist(), *changed], pa.int32()), pa.array([None] * len(key) + [sums[c].tolist() for c in changed], pa.list_(pa.int64()))],
        names=["key", "cells", "cluster", "sums"],
    )


def _moved(state: DataFrame, k: int, size: int, sums: np.ndarray) -> np.ndarray:
    """``sums`` and what ``state`` adds to them: k x (size + 1) numbers are read."""
    found = state.filter("sums is not null").select("cluster", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    out = sums.copy()
    for r in found.collect():
        out[r.cluster, r.d] += r.x
    return out


def _centroids(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The componentwise floor of sum over count; an empty cluster's centroid stays."""
    return np.array([s[:-1] // s[-1] if s[-1] else b for s, b in zip(sums, before, strict=True)], np.int64)


def approximate(vectors: DataFrame, size: int, bits: int) -> tuple[DataFrame | None, Cells | None]:
    """The written file of approximations, rows of CELLS, and what its cells are; none for an empty table."""
    at = [F.col("v")[d] for d in range(size)]
    spans = vectors.agg(F.array(*map(F.min, at)), F.array(*map(F.max, at)), F.array(*(F.percentile_approx(x, [0.002, 0.998], 1000) for x in at))).first()
    if spans[0][0] is None:
        return None, None
    made = Cells([(a, b, *q) for a, b, q in zip(*spans, strict=True)], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = made.of(_vectors(b.column(2), size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in cells], pa.binary()), b.column(2)], names=["key", "vec_id", "cells", "v"])

    keyed = vectors.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long"), "v")
    return saved(keyed.mapInArrow(run, CELLS), "centroids-vectors"), made


def cluster(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, bits: int = 6) -> tuple[DataFrame, dict]:
    """vec_id, cluster, distance of every whole vector of ``rows``, and a report: centroids, and of each round how many vectors were undecided and fetched.

    Vectors of another size, or with a null or non-finite component, go. A component x is
    floor(scale * x), at most FARTHEST either way. The first centroids are the ``k`` vectors of
    least SHA-256 of ``seed:vec_id`` (a null id: an empty one; equal hashes by components);
    fewer vectors make fewer centroids. ``rounds`` times each vector goes to its nearest
    centroid (squared distance; ties: the smaller number), and each centroid that has vectors
    becomes the floor of their mean; then vectors are assigned once more.

    Repeated rows are vectors of their own. An empty table gives no rows; other columns are
    ignored. No vector is shuffled but those fetched when they are too many to send their keys
    to each task, and no more than k x size sums reach the driver.
    """
    spark = rows.sparkSession
    for_python(spark)
    vectors = rows.filter(whole(F.col(vector), size)).select(F.col(vec_id).alias("vec_id"), integers(F.col(vector), scale).alias("v"))
    kept, cells = approximate(vectors, size, bits)
    if kept is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), {"centroids": [], "fetched": [], "undecided": []}
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("vec_id", "v").orderBy(hashed, "v").limit(k).collect()  # k vectors
    centroids = np.array([r.v for r in first], np.int64)
    n, report = len(centroids), {"fetched": [], "undecided": []}
    state, sums = None, np.zeros((n, size + 1), np.int64)
    for r in range(rounds):
        now, tables = centroids, cells.tables(centroids)
        state = _all(kept, now, tables, size) if r == 0 else _some(kept, state, now, tables, size, report)
        sums = _moved(state, n, size, sums)
        centroids = _centroids(sums, centroids)
        state = state.filter("sums is null")
    report["centroids"] = centroids.tolist()
    return _distances(kept, centroids, cells.tables(centroids), size), report


def _all(kept: DataFrame, centroids: np.ndarray, tables: list, size: int) -> DataFrame:
    """The first round's state: all vectors are read, for the sums; distances only where intervals overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, able = _vectors(b.column(2), size), candidates(_cells(b.column(1), size), tables)
            best, open_ = able.argmax(1).astype(np.int32), np.flatnonzero(able.sum(1) > 1)
            best[open_] = nearest(v[open_], able[open_], centroids)[0]
            sums = np.zeros((len(centroids), size + 1), np.int64)
            _added(v, best, len(centroids), sums)
            yield _state(b.column(0), b.column(1), best, sums)

    return saved(kept.select("key", "cells", "v").mapInArrow(run, STATE), "centroids-state")


def _some(kept: DataFrame, state: DataFrame, centroids: np.ndarray, tables: list, size: int, report: dict) -> DataFrame:
    """A later round's state: cells are read, and full vectors of the undecided and of those that move."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            able = candidates(_cells(b.column(1), size), tables)
            alone, best = able.sum(1) == 1, able.argmax(1)
            now = [int(c) if a else None for c, a in zip(best, alone, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(now, pa.int32()), pa.array([x.tobytes() for x in np.packbits(able, axis=1)], pa.binary())], names=["key", "cells", "old", "cluster", "able"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for b in batches:
            v = _vectors(b.column(4), size)
            able = np.unpackbits(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(v), -1), axis=1, count=k).astype(bool)
            best, old = nearest(v, able, centroids)[0], b.column(2).to_numpy()
            sums, moved = np.zeros((k, size + 1), np.int64), best != old
            _added(v[moved], best[moved], k, sums)
            _added(v[moved], old[moved], k, sums, -1)
            yield _state(b.column(0), b.column(1), best, sums)

    seen = saved(state.select("key", "cells", "cluster").mapInArrow(compare, "key long, cells binary, old int, cluster int, able binary"), "centroids-seen")
    stays = F.col("cluster").isNotNull() & (F.col("cluster") == F.col("old"))
    wanted = seen.filter(~stays).select("key", "cells", "old", "able")
    undecided, fetched = seen.agg(F.coalesce(F.sum(F.col("cluster").isNull().cast("long")), F.lit(0)), F.coalesce(F.sum((~stays).cast("long")), F.lit(0))).first()
    report["undecided"].append(undecided)
    report["fetched"].append(fetched)
    keys = F.broadcast(wanted) if fetched <= FETCH else wanted
    got = kept.select("key", "v").join(keys, "key").select("key", "cells", "old", "able", "v").mapInArrow(exact, STATE)
    return seen.filter(stays).select("key", "cells", "cluster", F.lit(None).cast("array<bigint>").alias("sums")).unionByName(saved(got, "centroids-fetched"))


def _distances(kept: DataFrame, centroids: np.ndarray, tables: list, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            able = candidates(_cells(b.column(1), size), tables)
            best, distance = nearest(_vectors(b.column(2), size), able, centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return saved(kept.select("vec_id", "cells", "v").mapInArrow(run, "vec_id long, cluster int, distance long"), "centroids-clusters")


def clusters(spark: SparkSession, rows: DataFrame, **options) -> DataFrame:
    """``cluster``'s rows, with cluster_inertia and inertia (a null beyond a long) and the centroid's SHA-256."""
    found, report = cluster(rows, **options)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(report["centroids"])]
    names = spark.createDataFrame(digests, T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid_sha256", T.StringType())]))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = found.groupBy("cluster").agg(total.alias("own")).join(names, "cluster")
    everything = each.agg(F.sum("own")).first()[0]
    long = lambda x: F.expr(f"try_cast({x} as bigint)")
    each = each.select("cluster", long("own").alias("cluster_inertia"), long(f"cast({everything if everything is not None else 0} as decimal(38,0))").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid
