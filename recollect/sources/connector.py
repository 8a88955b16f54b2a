"""The connector contract as a Python data source: what a poll of a folder of pages discovers.

``spark.read.format("page_connector").load(folder)`` polls once; ``spark.readStream`` polls again and
again, each time from the offset that the poll before ended at, so that a second poll gives only
what is new. A folder's files are its partitions. The folder is one that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from recollect.sources.shared import ship

#: The contract: what each discovered entry tells.
CONTRACT = "source_path string, content_hash string, content_type string, size_bytes bigint, blob_key string, metadata string"
COLUMNS = [c.split()[0] for c in CONTRACT.split(", ")]
#: Pages of a file that are read at once.
PAGES = 500


class PageFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def files(folder: str) -> list[tuple[int, str]]:
    """(time in ns, path) of the Parquet files of a folder, or of the one file that it is, oldest first."""
    folder = folder.removeprefix("file:").replace("///", "/")
    found = [folder] if os.path.isfile(folder) else [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet") and f[0] not in "._"]
    return sorted((os.stat(f).st_mtime_ns, f) for f in found)


def entries(path: str) -> Iterator[pa.RecordBatch]:
    """The contract's columns of each page of a file; a page without html has no hash and no size."""
    for b in pq.ParquetFile(path).iter_batches(PAGES, columns=["page_id", "url", "html"]):
        out = []
        for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = None if html is None else html.encode()
            digest = None if data is None else hashlib.sha256(data).hexdigest()
            out.append((url, digest, "text/html", None if data is None else len(data), None if digest is None else f"blobs/{digest}", json.dumps({"page": page}, separators=(",", ":"))))
        kinds = [pa.int64() if c == "size_bytes" else pa.string() for c in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=COLUMNS)


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [PageFile(f) for _, f in files(self.folder)]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        return entries(partition.path)


class PageStream(DataSourceStreamReader):
    """Offsets are the time and name of the newest file that was seen; later ones are new."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        time, path = max(files(self.folder), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = ((x["time"], x["path"]) for x in (start, end))
        return [PageFile(f[1]) for f in files(self.folder) if after < f <= upto]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        return entries(partition.path)


class PageConnector(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_connector"

    def schema(self) -> str:
        return CONTRACT

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PageReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return PageStream(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PageConnector)
    return ship(spark)
