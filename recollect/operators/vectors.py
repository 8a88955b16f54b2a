"""Vector search: a stated set of queries against all rows, in blocks.

Queries are packed into blocks of bounded size, each one row of a table with a matrix in it. If
all of them are small, by their measured size, they are sent to every task, and rows stay where
they are. Otherwise rows are packed into large blocks as well and shuffled once, and every one of
them is sent the query blocks, which its task takes one after the other. Of a block of rows only
the best of each query goes on, and Spark cuts those down again before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.vectors import cosine
from recollect.sources.shared import saved, ship

#: Queries, and rows, that are multiplied at once: their product in 8 byte numbers is what a task holds.
QUERIES, ROWS = 2048, 4096
#: Bytes of all queries up to which they are sent to every task, and of a block of rows beyond that.
BROADCAST, BLOCK = 32 << 20, 16 << 20
#: Stands for no group.
NONE = -(2**63)
FIELDS = ("id", "group", "first", "matrix", "n", "wide")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norms = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _signs(m: np.ndarray) -> np.ndarray:
    return np.where(m > 0, 1.0, -1.0)


def _records(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, group, first and matrix: where each record's vectors begin in the matrix of all of them."""
    counts = np.array([len(x) for x in batch.column(2)])
    return batch.column(0).to_numpy(), batch.column(1).fill_null(NONE).to_numpy(), np.cumsum(counts) - counts, _matrix(batch.column(2).flatten())


def _source(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("embeddings") > 0).select(F.col("id").cast("long"), F.col("group").cast("long"), "embeddings")


def packed(rows: DataFrame, size: int, most: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` records, or some ``most`` bytes: FIELDS, as ``_records`` gives them, in bytes.

    ``rows`` has id, group (a bigint, may be null) and embeddings, the record's vectors, of n
    rows in the matrix and of floats or, if ``wide``, doubles. Records without vectors go.
    """

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        *fields, matrix = _records(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
        return pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (*fields, matrix)), pa.array([len(matrix)], pa.int64()), pa.array([matrix.dtype == np.float64])], names=list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, bytes_ = [], 0, 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                held.append(part)
                n, bytes_, b = n + part.num_rows, bytes_ + part.nbytes, b.slice(part.num_rows)
                if n >= size or bytes_ >= most:
                    yield block(held)
                    held, n, bytes_ = [], 0, 0
        if held:
            yield block(held)

    return _source(rows).mapInArrow(run, "id binary, group binary, first binary, matrix binary, n long, wide boolean")


def _unpacked(row: dict, prepare: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    matrix = np.frombuffer(row["matrix"], np.float64 if row["wide"] else np.float32).reshape(row["n"], -1)
    return (*(np.frombuffer(row[c], np.int64) for c in ("id", "group", "first")), prepare(matrix))


def _cut(ids: np.ndarray, group: np.ndarray, first: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """A block of rows in parts of about ROWS vectors, none of a record in two parts."""
    begin = 0
    while begin < len(ids):
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + ROWS, side="right")) - 1) if first[-1] >= first[begin] + ROWS else len(ids)
        last = first[end] if end < len(ids) else len(matrix)
        yield ids[begin:end], group[begin:end], first[begin:end] - first[begin], matrix[first[begin] : last]
        begin = end


def meet(rows: DataFrame, queries: DataFrame, found: Callable[..., list[np.ndarray]], schema: str, prepare: Callable[[np.ndarray], np.ndarray] = _unit, block: int = QUERIES) -> DataFrame:
    """What ``found`` gives of each block of queries and block of rows, as rows of ``schema``.

    ``found`` takes id, group, first and matrix of the queries, then those of the rows.
    """
    spark = ship(rows.sparkSession)
    columns = [c.split()[0] for c in schema.split(", ")]
    asked = saved(packed(queries, block), "vector-queries").select(*FIELDS)
    size = asked.agg(F.coalesce(F.sum(F.length("matrix") + 3 * F.length("id")), F.lit(0))).first()[0]

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=columns)

    if size <= BROADCAST:
        sent = spark.sparkContext.broadcast([r.asDict() for r in asked.collect()])  # BROADCAST bytes at most

        def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = [_unpacked(q, prepare) for q in sent.value]
            for b in batches:
                if b.num_rows:
                    *fields, matrix = _records(b)
                    for part in _cut(*fields, prepare(matrix)):
                        yield from (out(found(*q, *part)) for q in ready)

        return _source(rows).mapInArrow(stay, schema)

    blocks = saved(packed(rows, BLOCK // 64).withColumn("block", F.monotonically_increasing_id()), "vector-rows").withColumn("asks", F.lit(False))
    every = blocks.agg(F.collect_list("block")).scalar()  # a number a block
    both = blocks.unionByName(asked.withColumns({"block": F.explode(every), "asks": F.lit(True)}))
    ordered = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "asks")

    def come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if not row["asks"]:
                    parts = list(_cut(*_unpacked(row, prepare)))
                else:
                    q = _unpacked(row, prepare)
                    yield from (out(found(*q, *part)) for part in parts)

    return ordered.select(*FIELDS, "asks").mapInArrow(come, schema)


def _single(rows: DataFrame, group: str | None) -> DataFrame:
    own = F.col(group) if group else F.lit(None)
    return rows.filter("embedding is not null").select("id", own.cast("long").alias("group"), F.array("embedding").alias("embeddings"))


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of the ``k`` greatest of each query's ``sims``, equal ones by id; those of -inf don't count.

    Only what reaches a query's k-th greatest is sorted.
    """
    n, width = sims.shape
    least = np.partition(sims, width - k, axis=1)[:, width - k, None] if k < width else np.full((n, 1), -np.inf)
    which, row = np.nonzero((sims >= least) & (sims > -np.inf))
    order = np.lexsort((ids[row], -sims[which, row], which))
    which, row = which[order], row[order]
    keep = np.arange(len(which)) - np.searchsorted(which, which) < k
    return which[keep], row[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, skip_self: bool = True, same: str | None = None, each: str | None = None, signs: bool = False, block: int = QUERIES) -> DataFrame:
    """query_id, id, similarity, rank of the ``k`` rows of greatest cosine to each query.

    Both have id and embedding. Similarities are rounded before they are ranked; equal ones
    rank by id. With ``same``, a bigint column of both, only rows of the query's value count;
    with ``each``, one of the rows, there are ``k`` of each of its values, in column each. With
    ``signs`` only the signs of the elements are compared: similarity is 1 - 2 x the share that
    differs.
    """

    def found(qs: np.ndarray, mine: np.ndarray, _: np.ndarray, m: np.ndarray, ids: np.ndarray, theirs: np.ndarray, __: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for value in np.intersect1d(mine, theirs) if same else np.unique(theirs) if each else [NONE]:
            asks = np.flatnonzero(mine == value) if same else slice(None)
            rows = np.flatnonzero(theirs == value) if same or each else slice(None)
            sims = m[asks] @ own[rows].T
            sims = (sims / m.shape[1] if signs else np.round(sims, digits)) + 0.0
            if skip_self:
                sims[qs[asks][:, None] == ids[rows][None, :]] = -np.inf
            i, j = _best(ids[rows], sims, k)
            out.append((qs[asks][i], ids[rows][j], sims[i, j], np.full(len(i), value)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    group = same or each
    out = meet(_single(vectors, group), _single(queries, same), found, "query_id long, id long, similarity double, each long", _signs if signs else _unit, block)
    order = Window.partitionBy("query_id", *(["each"] if each else [])).orderBy(F.desc("similarity"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out if each else out.drop("each")


def within(vectors: DataFrame, queries: DataFrame, least: float, digits: int = 6, block: int = QUERIES) -> DataFrame:
    """query_id, id, similarity of every other row whose cosine to a query is at least ``least``."""

    def found(qs, _, __, m, ids, *rest) -> list[np.ndarray]:
        sims = np.round(m @ rest[-1].T, digits) + 0.0
        i, j = np.nonzero((sims >= least) & (qs[:, None] != ids[None, :]))
        return [qs[i], ids[j], sims[i, j]]

    return meet(_single(vectors, None), _single(queries, None), found, "query_id long, id long, similarity double", block=block)


def near_links(vectors: DataFrame, least: float, digits: int = 6, block: int = QUERIES) -> DataFrame:
    """src, dst: links that connect all rows whose cosine is at least ``least``, all rows against all.

    Two blocks give a tree's worth of links, not all pairs, so a large group of copies gives
    few.
    """

    def found(qs, _, __, m, ids, *rest) -> list[np.ndarray]:
        if qs.min() >= ids.max():  # each pair is linked from its smaller id
            return [np.empty(0, np.int64)] * 2
        near = np.round(m @ rest[-1].T, digits) >= least
        own = {int(x): int(x) for x in (*qs, *ids)}

        def root(x: int) -> int:
            while own[x] != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        out = []
        for i, q in enumerate(qs.tolist()):
            for other in ids[near[i]].tolist():
                if q < other and (a := root(q)) != (b := root(other)):
                    own[max(a, b)] = min(a, b)
                    out.append((q, other))
        return list(np.array(out, np.int64).reshape(-1, 2).T)

    return meet(_single(vectors, None), _single(vectors, None), found, "src long, dst long", block=block)


def score_candidates(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, id, similarity, rank: of each query's ``candidates`` (query_id, id) the ``k`` of greatest cosine, exactly.

    Candidates without a vector go; one named twice counts once; a vector of zeros scores 0.
    """
    pairs = candidates.select("query_id", "id").distinct().join(vectors.select("id", "embedding"), "id")
    pairs = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    scored = pairs.select("query_id", "id", (F.round(cosine(F.col("embedding"), F.col("asked")), digits) + 0.0).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _score(m: np.ndarray, first: np.ndarray, own: np.ndarray, begins: np.ndarray, digits: int) -> np.ndarray:
    """[query, group]: for each token of a query the greatest cosine to the group's tokens, summed."""
    most = np.maximum.reduceat(m @ own.T, begins, axis=1)
    return np.round(np.add.reduceat(most, first, axis=0), digits) + 0.0


def _tokens(rows: DataFrame, key: str, distinct_tokens: bool = False) -> DataFrame:
    embeddings = F.array_distinct("embeddings") if distinct_tokens else F.col("embeddings")
    return rows.select(F.col(key).alias("id"), F.lit(None).alias("group"), embeddings.alias("embeddings"))


def maxsim(tokens: DataFrame, queries: DataFrame, distinct_tokens: bool = False, digits: int = 6, k: int | None = None, block: int = QUERIES // 8) -> DataFrame:
    """query_id, group_id, score: for each token of a query the greatest cosine to the group's tokens, summed.

    ``tokens`` has group_id and embeddings (array of vectors), ``queries`` id and embeddings.
    With ``distinct_tokens`` equal query tokens count once. With ``k`` only the ``k`` best groups
    of each query, equal scores by group_id, and their rank.
    """

    def found(qs, _, first, m, ids, __, begins, own) -> list[np.ndarray]:
        total = _score(m, first, own, begins, digits)
        i, j = _best(ids, total, k or len(ids))
        return [qs[i], ids[j], total[i, j]]

    out = meet(_tokens(tokens, "group_id"), _tokens(queries, "id", distinct_tokens), found, "query_id long, group_id long, score double", block=block)
    if k is None:
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def maxsim_of(pairs: DataFrame, tokens: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, group_id, score of the given pairs (query_id, group_id) alone; as ``maxsim``."""
    ship(pairs.sparkSession)
    rows = pairs.join(tokens.select("group_id", F.col("embeddings").alias("own")), "group_id").join(queries.select(F.col("id").alias("query_id"), F.col("embeddings").alias("asked")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [_score(_unit(_matrix(q.values)), np.zeros(1, int), _unit(_matrix(o.values)), np.zeros(1, int), digits)[0, 0] for q, o in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["query_id", "group_id", "score"])

    wanted = rows.filter((F.size("own") > 0) & (F.size("asked") > 0))
    return wanted.select(F.col("query_id").cast("long"), F.col("group_id").cast("long"), "asked", "own").mapInArrow(run, "query_id long, group_id long, score double")


class InvertedLists:
    """An index for approximate search: rows listed under the nearest of some centres.

    The centres are learned by k-means on at most ``sample`` rows, those of least
    xxhash64(id): the documented bound. Every row is indexed.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, sample: int = 20_000, rounds: int = 10):
        rows = vectors.filter("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"].tolist()
        points = _unit(np.array(rows, np.float64))
        centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
        for _ in range(rounds):
            nearest = (points @ centres.T).argmax(1)
            centres = _unit(np.array([points[nearest == i].sum(0) if (nearest == i).any() else c for i, c in enumerate(centres)]))
        self.centres = centres
        self.rows = self.assign(vectors, 1)

    def assign(self, vectors: DataFrame, probes: int) -> DataFrame:
        """The rows with ``list``: one row for each of the ``probes`` nearest centres."""
        shipped = ship(vectors.sparkSession).sparkContext.broadcast(self.centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = np.argsort(-(_unit(_matrix(b.column(1))) @ shipped.value.T), axis=1, kind="stable")[:, :probes]
                take = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(near.ravel().astype(np.int32))], names=["id", "embedding", "list"])

        return vectors.filter("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(place, "id long, embedding array<float>, list int")

    def search(self, queries: DataFrame, k: int, probes: int = 12, digits: int = 6) -> DataFrame:
        """query_id, id, similarity, rank among the rows of each query's ``probes`` nearest lists, by products of blocks."""
        listed = lambda rows: rows.select("id", "embedding", F.col("list").cast("long").alias("list"))
        return search(listed(self.rows), listed(self.assign(queries, probes)), k, digits, same="list")
