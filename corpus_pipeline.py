"""From raw documents to a training mix: the stages, and ``run``, which applies them in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, language, mixing, secrets, simhash
from recollect.llm.common import fresh, saved, table

#: A document goes if its language can't be told, or is told with less than this.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` holds it from here on.

    Null texts, and texts without letters, go. Whole texts are read, however long. Repeated rows
    are judged alike and all stay; of equally likely languages the first by name is taken. An
    empty table stays empty; columns of any name stay.
    """
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    told, score = fresh(docs, "lang_pred", "score")
    judged = language.predict(docs, model, docs.columns, "text", (told, score))
    kept = judged.filter((F.col(told) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(told)).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least doc_id.

    Null ids come last; of rows with one id that of the least hash of its text stays, of repeated
    rows one. Texts without words, null ones too, are one group; very long texts are one set of
    shingles. An empty table stays empty; columns of any name stay.
    """
    return simhash.first_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; whole texts are searched. Repeated rows are judged
    alike. An empty table stays empty; columns of any name stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced, in whole texts.

    Null and empty texts, repeated rows and columns of any name stay as they are; an empty table
    stays empty.
    """
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, their texts, and how many words it takes of each.

    Null and empty texts have no words and go. Repeated rows are documents of their own; ties in
    the order are broken by source and key. A very long text is taken in part if its source's
    share ends in it. An empty table stays empty; size, source_size, target and taken are set anew.
    """
    return mixing.mix_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("mixing", mixed),
]
#: The learned stages (language, secrets) and XXH64 can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
