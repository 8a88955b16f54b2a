"""The connector as a data source: what a poll gives, how it is cut, and that the next poll gives only what is new."""

import hashlib
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recollect.sources import connector


def write(folder, name, rows):
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": pa.array([r[2] for r in rows], pa.string())}), os.path.join(folder, f"{name}.parquet"))
    time.sleep(0.05)


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path, "b", [(1, "u1", "<p>é</p>"), (2, "u2", None)])
    write(tmp_path, "a", [(3, "u3", "")])
    (tmp_path / "notes.txt").write_text("no page")
    return str(tmp_path)


def test_a_poll_and_its_partitions(spark, folder):
    df = connector.register(spark).read.format("page_connector").load(folder)
    assert df.columns == connector.COLUMNS and df.rdd.getNumPartitions() == 2
    found = {r.source_path: r for r in df.collect()}
    digest = hashlib.sha256("<p>é</p>".encode()).hexdigest()
    assert tuple(found["u1"]) == ("u1", digest, "text/html", 9, f"blobs/{digest}", '{"page":1}')
    assert tuple(found["u2"])[1:5] == (None, "text/html", None, None) and found["u3"].size_bytes == 0


def test_the_next_poll_gives_only_what_is_new(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("polls")

    def poll():
        stream = connector.register(spark).readStream.format("page_connector").load(folder)
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.source_path for r in spark.read.schema(connector.CONTRACT).parquet(f"{at}/rows").collect())

    assert poll() == ["u1", "u2", "u3"]
    assert poll() == ["u1", "u2", "u3"]
    write(folder, "0", [(4, "u4", "x")])
    assert poll() == ["u1", "u2", "u3", "u4"]
