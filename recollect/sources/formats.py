"""Dataset files: formats told by name, read and written; files of a folder as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of the dataset formats and the document types.
DATASETS = {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "pq": "parquet", "jsonl": "json", "ndjson": "json", "json": "json"}
DOCUMENTS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html", "docx": "docx", "pptx": "pptx"}


def suffix(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([^./]+)$", 1)


def kind(name: Column, kinds: dict[str, str]) -> Column:
    """The format that a file's name tells, null if it's none of ``kinds``."""
    return F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[suffix(name)]


def format_of(path: str) -> str:
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end not in DATASETS:
        raise ValueError(f"unknown dataset format: {path}")
    return DATASETS[end]


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset of the format that its name tells; types are inferred without ``schema``."""
    fmt = format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        return reader.csv(path, header=True, inferSchema=schema is None, sep="\t" if fmt == "tsv" else ",", multiLine=False, escape='"')
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def write(df: DataFrame, path: str) -> None:
    fmt = format_of(path)
    if fmt in ("csv", "tsv"):
        df.write.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')
    elif fmt == "json":
        df.write.json(path)
    else:
        df.write.parquet(path)


def poll_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """source_path, content_hash, content_type, size_bytes of each file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("content_hash"), F.coalesce(kind(F.col("path"), DOCUMENTS | DATASETS), F.lit("application/octet-stream")).alias("content_type"), F.col("length").alias("size_bytes"))


def new_files(polled: DataFrame, catalog: DataFrame, full: bool = False) -> DataFrame:
    """What a sync registers: unknown contents, each once; all that was polled if ``full``."""
    if full:
        return polled
    once = polled.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in polled.columns if c != "content_hash"]), "source_path").alias("f"))
    return once.select("content_hash", "f.*").join(catalog.select("content_hash"), "content_hash", "left_anti")


def scraped(responses: DataFrame) -> DataFrame:
    """source_path, content_hash, content_type, size_bytes, metadata of the pages that could be fetched.

    ``responses`` has url, status, content_type (a header, null for none) and body. A response
    that failed, or without a body, is no entry; of the header what stands before a semicolon counts.
    """
    good = responses.filter("status between 200 and 299 and body is not null")
    kind = F.trim(F.substring_index(F.coalesce("content_type", F.lit("text/html")), ";", 1))
    told = F.to_json(F.struct(F.col("status").alias("status_code"), "url"))
    return good.select(F.col("url").alias("source_path"), F.sha2("body", 256).alias("content_hash"), kind.alias("content_type"), F.octet_length("body").cast("long").alias("size_bytes"), told.alias("metadata"))
