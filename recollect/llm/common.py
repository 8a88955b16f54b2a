"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.sources.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local master, where all run on one
    machine, gets a temporary folder when it is unset; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-recollect-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: whoever needs it reads the written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read again.

    Cuts the lineage, so that what is used twice is computed once and a lost executor
    costs a read of a file. The folder's owner clears it after the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with leaving_no_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str | list[str], n: int) -> DataFrame:
    """``saved`` in ``n`` buckets of ``key``: joins of such tables by all of it shuffle neither of them.

    The session's catalog holds the table only until its files are found.
    """
    spark = df.sparkSession
    title = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    with leaving_no_shuffles(spark):
        df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{title}").saveAsTable(title)
    out = spark.table(title)
    out.schema  # noqa: B018 - resolves the files
    spark.sql(f"DROP TABLE {title}")
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be none of ``df``'s columns."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def least_by_hash(rows: DataFrame, kind: str, n: int, hash_of: list[str], order: list[str]) -> DataFrame:
    """Of each value of ``kind`` the ``n`` rows of least xxhash64 of ``hash_of``, then by ``order``.

    Kinds are counted first, and rows whose hash is far above what ``n`` of them reach are
    dropped where they are read, so that the sort holds little more than the sample whatever
    the table's size.
    """
    spread = F.pmod(F.xxhash64(*hash_of), F.lit(1 << 30))
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("_count"))
    near = rows.withColumn("_h", spread).join(F.broadcast(counts), kind)  # a row a kind
    near = near.filter(F.col("_h") * F.col("_count") <= F.lit(float(1 << 30)) * (1.5 * n + 100))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("_h", *order))
    return near.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n", "_count", "_h")


def for_python(spark: SparkSession) -> None:
    """Readies a session for Python tasks: the executors get this package, all of it, once an application."""
    ship(spark)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task makes of long texts fits its memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
