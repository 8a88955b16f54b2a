"""Row rules and small expressions shared by listings and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.like(v),
}


def tags_all(tags: Column, wanted: list[str]) -> Column:
    """Whether the array holds every wanted tag."""
    return reduce(lambda a, b: a & b, [F.array_contains(tags, w) for w in wanted], F.lit(True))


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def json_contains(column: Column, wanted: dict[str, str]) -> Column:
    """Whether a JSON object has these scalar members."""
    return reduce(lambda a, b: a & b, [F.get_json_object(column, f"$.{k}") == F.lit(str(v)) for k, v in wanted.items()], F.lit(True))


def condition(df: DataFrame, column: str, op: str, value: object) -> Column:
    """One filter of a slice request; an unknown column or operator is an error, never ignored."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}")
    if op == "in" and not isinstance(value, (list, tuple, set)):
        raise ValueError("'in' takes a list")
    return OPERATORS[op](F.col(f"`{column}`"), value)


def with_total(rows: DataFrame, page: DataFrame) -> DataFrame:
    """``page`` with the number of ``rows`` in a column total."""
    return page.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def entity_name(name: Column) -> Column:
    """A name for comparison: lower case, one space between words, none at the ends."""
    return collapse(F.lower(name))
