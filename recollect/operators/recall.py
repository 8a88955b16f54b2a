"""Keyword retrieval, rank fusion and the merge of tiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.stemming import with_stems
from recollect.sources.shared import saved

TOKEN = "[a-z0-9]+"


def terms(text: Column) -> Column:
    """The lower-cased runs of ASCII letters and digits of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, digits: int = 6, same: str | None = None) -> DataFrame:
    """query_id, id, score of each document with a term of a query; both have id and text.

    Terms are stemmed, each different one once. Only the queries' terms are counted beyond a
    document's length, so postings of other terms are dropped where they arise; lengths come
    from the same pass. A query's repeated term counts once, and a query without terms finds
    nothing. With ``same``, a column of both, only documents of the query's value are found (none
    for a null), while weights are those of all documents.
    """
    context = [same] if same else []
    words = queries.select(F.col("id").alias("query_id"), *context, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    asked = saved(with_stems(words.select("term").distinct(), "term"), "bm25-stems").join(words, "term").select("query_id", *context, "stem").distinct()
    asked = saved(asked, "bm25-asked")
    forms = saved(with_stems(docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "term"), "bm25-stems")
    length = docs.sparkSession.createDataFrame([("", "")], "term string, stem string")  # stands for a document as a whole
    forms = saved(forms.join(asked.select("stem").distinct(), "stem", "left_semi").select("term", "stem").union(length), "bm25-forms")
    found = docs.select("id", *context, terms(F.col("text")).alias("ts")).select("id", *context, F.size("ts").alias("length"), F.explode(F.array_append("ts", F.lit(""))).alias("term"))
    tf = saved(found.join(forms, "term").groupBy("id", *context, "length", "stem").agg(F.count(F.lit(1)).alias("tf")), "bm25-postings")
    stats = tf.filter("stem = ''").agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))).scalar()
    tf = tf.filter("stem <> ''")
    df = tf.groupBy("stem").agg(F.count(F.lit(1)).alias("df")).withColumn("stats", stats)
    idf = F.log(F.lit(1.0) + (F.col("stats.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = saved(df.select("stem", idf.alias("idf"), F.col("stats.mean").alias("mean")).join(asked, "stem"), "bm25-weights")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    # a document's postings meet in one task: its scores are summed there, and of these only what a query keeps is shuffled
    pairs = tf.repartition("id").join(weights, ["stem", *context])
    return pairs.groupBy("id", "query_id").agg(F.round(F.sum(part), digits).alias("score")).filter("score > 0").select("query_id", "id", "score")


def ranked(scores: DataFrame, k: int, by: str = "score", offset: int = 0) -> DataFrame:
    """The ``k`` best of each query after ``offset`` better ones, with rank; equal scores by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter((F.col("rank") <= offset + k) & (F.col("rank") > offset))


def fallback(first: DataFrame, queries: DataFrame, least: float, again: Callable[[DataFrame], DataFrame], mode: tuple[str, str] = ("rag", "llm")) -> DataFrame:
    """query_id, id, score, rank, mode: each query's ``first`` results, or those of a second retrieval.

    A query whose best score is under ``least``, or that found nothing, is searched ``again``:
    that search gets these queries alone, so its work grows with them. What it finds replaces
    the first results, none if it finds none.
    """
    first = saved(first.select("query_id", "id", "score", "rank"), "fallback-first")
    good = first.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= least).select("query_id")
    good = saved(good, "fallback-good")
    poor = queries.join(good, queries["id"] == good["query_id"], "left_anti")
    kept = first.join(good, "query_id", "left_semi").withColumn("mode", F.lit(mode[0]))
    return kept.unionByName(again(poor).select("query_id", "id", "score", "rank").withColumn("mode", F.lit(mode[1])))


def fuse(lists: list[DataFrame], k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank): 1 / (constant + rank), summed."""
    every = reduce(DataFrame.union, [x.select("query_id", "id", "rank") for x in lists])
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), digits)
    return ranked(every.groupBy("query_id", "id").agg(score.alias("score")), k)


def merge_tiers(hot: DataFrame, cold: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rows of both tiers, a hot one before its cold copy, the ``k`` most important of each group."""
    both = hot.withColumn("tier", F.lit(0)).unionByName(cold.withColumn("tier", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "id").orderBy("tier"))).filter("_n = 1").drop("_n")
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "id")
    return one.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def fill(hot: DataFrame, cold: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each group the ``k`` first: hot rows by importance, then cold ones that aren't hot, with rank."""
    both = hot.withColumn("tier", F.lit(0)).unionByName(cold.join(hot.select("id"), "id", "left_anti").withColumn("tier", F.lit(1)))
    order = Window.partitionBy(*by).orderBy("tier", F.desc("importance"), "id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).drop("tier")
