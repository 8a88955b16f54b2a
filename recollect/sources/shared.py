"""Tables written to the folder that all executors share, to cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own(spark.sparkContext.applicationId)


@lru_cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-recollect-{application}-")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package, all of it, to the executors, once an application, so that they need no install of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="recollect-")) / "recollect.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets of a shuffle by ``spread``, at most on average.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, shuffled by ``keys`` into more partitions than usual where a task would get over TASK_ROWS of them."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)
