"""Filtered, paged and counted listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.predicates import json_contains, tags_all, with_total


def filters(subtypes: list[str] | None = None, tags: list[str] | None = None, metadata: dict[str, str] | None = None, status: str | None = "active", context: str | None = None, user: str | None = None) -> Column:
    """The conditions of a filter search that are given, all of which must hold.

    Columns: type, tags (all wanted ones must be there), metadata (JSON that holds the wanted
    members), status, context, user_id.
    """
    given = [(subtypes, lambda v: F.col("type").isin(v)), (tags, lambda v: tags_all(F.col("tags"), v)), (metadata, lambda v: json_contains(F.col("metadata"), v))]
    given += [(v, lambda v, c=c: F.col(c) == v) for c, v in (("status", status), ("context", context), ("user_id", user))]
    return reduce(lambda a, b: a & b, [rule(v) for v, rule in given if v is not None], F.lit(True))


def vfs(connector_column: str, connector: str | None, group: str, allowed: list[str] | None, denied: list[str] | None, path: str, prefix: str | None) -> Column:
    """Entries of a connector whose group is allowed and not denied, the denial winning, under a prefix taken literally."""
    given = [F.col(connector_column) == connector if connector else None, F.col(group).isin(allowed) if allowed is not None else None, ~F.col(group).isin(denied) if denied else None, F.startswith(F.col(path), F.lit(prefix)) if prefix else None]
    return reduce(lambda a, b: a & b, [g for g in given if g is not None], F.lit(True))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset`` + ``limit`` of a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_and_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return with_total(rows, page(rows, order, limit, offset))


def hydrate(rows: DataFrame, key: str, request: DataFrame) -> DataFrame:
    """The rows of a request (pos, id), in its order, repeats kept, unknown ids dropped."""
    return request.join(rows, request["id"] == rows[key]).drop(rows[key])


def hydrate_once(rows: DataFrame, key: str, request: DataFrame) -> DataFrame:
    """As ``hydrate``; of repeats the first stays."""
    return hydrate(rows, key, request.groupBy("id").agg(F.min("pos").alias("pos")))


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, by a total order; rows of a group are cut down before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def top_of(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``rank``."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
