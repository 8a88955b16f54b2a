"""Slices and column profiles of tabular datasets."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.predicates import condition, with_total

#: Bins that a column's range is cut into, for histograms of ranks.
BINS = 4096


def slice_rows(data: DataFrame, columns: list[str] | None = None, filters: list[tuple[str, str, object]] = (), order_by: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A structured slice, with ``total``, the rows that match without the limit.

    Equal keys are ordered by all other columns, so that pages are stable.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be 1 to 10000")
    for name in [*(columns or []), *(f[0] for f in filters), *([order_by] if order_by else [])]:
        identifier(name)
        if name not in data.columns:
            raise ValueError(f"no column {name!r}")
    rows = data.filter(reduce(lambda a, b: a & b, [condition(data, *f) for f in filters], F.lit(True)))
    keys = [F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_last()] if order_by else []
    page = rows.orderBy(*keys, *(c for c in data.columns if c != order_by)).offset(offset).limit(limit)
    return with_total(rows, page.select(*(columns or data.columns)))


def total_matching(data: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """One row, total_matching: the rows that a slice's filters let through."""
    return data.filter(reduce(lambda a, b: a & b, [condition(data, *f) for f in filters], F.lit(True))).agg(F.count(F.lit(1)).alias("total_matching"))


#: Nodes of a resolved statement that only read, those that bring rows of their own, and functions that call anything.
READING = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset SubqueryAlias Union Distinct Deduplicate Join LateralJoin Window Except Intersect Expand Generate Sample Pivot Unpivot WithCTE CTERelationDef UnionLoop".split())
OWN_ROWS = frozenset("OneRowRelation LocalRelation ResolvedInlineTable CTERelationRef UnionLoopRef".split())
CALLING = frozenset("CallMethodViaReflection TryReflect".split())
#: Words that no statement for a dataset may hold, by the rule for stored requests.
CHANGING = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE")
NAME = r"^[\w\s\-.]+$"


def _all(seq) -> list:  # noqa: ANN001 - a Scala sequence
    return [seq.apply(i) for i in range(seq.size())]


def _calls(expression) -> None:  # noqa: ANN001 - a Catalyst expression
    if expression.getClass().getSimpleName() in CALLING:
        raise ValueError("no calls of methods")
    for below in _all(expression.children()):
        _calls(below)


def _reads_only(plan, view: str) -> None:  # noqa: ANN001 - a Catalyst plan
    """Raises unless a resolved plan reads nothing but ``view``, whose name nobody can know."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind == "SubqueryAlias" and plan.identifier().name() == view:
        return
    below = _all(plan.children())
    if kind not in (READING if below else OWN_ROWS):
        raise ValueError(f"not allowed in a slice: {kind}" if below else "only data may be read")
    for expression in _all(plan.expressions()):
        _calls(expression)
    for child in below:
        _reads_only(child, view)


def _composed(statement: str, view: str) -> str:
    rest = re.sub(r"(?is)^\s*with\b(?!\s+recursive\b)", ",", statement, count=1)
    return f"WITH data AS (SELECT * FROM {view}){rest if rest != statement else ' ' + statement}"


def guarded(data: DataFrame, statement: str, view: str) -> None:
    """Raises unless a statement over ``view`` is a query of it alone; it is resolved, nothing runs.

    The resolved plan, with all its subqueries, may hold only nodes that read, and every relation
    in it must be ``view`` or rows that the statement writes out itself. So what a name stands
    for is Spark's own answer: a common table expression that hides another table, or a text or
    alias that looks like a name, changes nothing.
    """
    if not re.match(r"\s*(select|with)\b", statement, re.I):
        raise ValueError("only one SELECT is allowed")
    session = data.sparkSession
    state = session._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(_composed(statement, view))
        resolved = state.executePlan(parsed, session._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
    except (AnalysisException, ParseException) as wrong:
        raise ValueError(f"not a query of data: {wrong}") from wrong
    for plan in (resolved, *_all(resolved.subqueriesAll())):
        _reads_only(plan, view)


def identifier(name: str) -> str:
    """A column's name for use in SQL, quoted; an error if it isn't letters, digits, underscores, blanks, hyphens and points."""
    if not re.match(NAME, name):
        raise ValueError(f"not a name: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def identifiers(name: Column) -> tuple[Column, Column]:
    """``identifier`` of a column of names: whether each is one, and it in double quotes, else null."""
    good = F.coalesce(name.rlike(NAME), F.lit(False))
    return good, F.when(good, F.concat(F.lit('"'), F.regexp_replace(name, '"', '""'), F.lit('"')))


def statements(sql: Column) -> tuple[Column, Column]:
    """For a column of statements: the word for which each is refused (``SELECT``: it isn't one), else null, and it without blanks and closing semicolons."""
    stripped = F.regexp_replace(F.trim(sql), ";+$", "")
    upper = F.upper(stripped)
    refused = F.coalesce(*(F.when(upper.rlike(rf"\b{word}\b"), word) for word in CHANGING), F.when(~upper.startswith("SELECT"), "SELECT"))
    return refused, F.when(refused.isNull(), stripped)


def slice_sql(data: DataFrame, statement: str) -> DataFrame:
    """The rows of a SELECT over ``data``; see ``guarded`` for what is refused.

    The statement sees ``data`` as a common table expression over a view of a name of its own,
    so callers in one session don't meet.
    """
    statement = re.sub(r"[;\s]+$", "", statement)
    view = f"slice_{uuid.uuid4().hex}"
    data.createOrReplaceTempView(view)
    try:
        guarded(data, statement, view)
        return data.sparkSession.sql(_composed(statement, view))
    finally:
        data.sparkSession.catalog.dropTempView(view)


def _long(data: DataFrame, columns: list[str], kind: str) -> DataFrame:
    return data.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns))).alias("x")).select("x.*")


def null_profile(data: DataFrame) -> DataFrame:
    """column, nulls, percent, n_unique (null counts as a value) of each column."""
    n = F.count(F.lit(1))
    parts = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col(c).isNull()), n), 2).alias("percent"), (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias("n_unique"))
        for c in data.columns
    ]
    return data.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def numeric_profile(data: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """column, n, min, max, mean, std (0 when n is 1) of numeric columns."""
    std = F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value"))
    return _long(data, columns, "double").groupBy("column").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), digits).alias("mean"), F.round(std, digits).alias("std"))


def quantiles(data: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, q, value: the value of rank round((n - 1) x q), exactly, without sorting a column.

    A histogram of each column's range tells in which bin a rank lies; only the values of that
    bin are counted one by one. Null values don't count.
    """
    rows = _long(data, columns, "double").filter("value is not null")
    bounds = rows.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(F.lit(0)).cast("int")
    binned = rows.join(F.broadcast(bounds), "column").withColumn("bin", place)  # a row a column
    earlier = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    rank = F.floor((F.col("n") - 1) * F.col("q") + 0.5)
    wanted = bins.withColumn("q", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", rank).filter("rank >= before and rank < before + c").select("column", "bin", "q", "rank", "before")
    inside = binned.join(F.broadcast(wanted), ["column", "bin"]).groupBy("column", "q", "value").agg(F.count(F.lit(1)).alias("c"), F.first("rank").alias("rank"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("column", "q").orderBy("value"))
    return inside.withColumn("upto", upto).filter("upto > rank").groupBy("column", "q").agg(F.min("value").alias("value"))


def histogram(data: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (0 on), low, high, n of equal-width bins over the range; the maximum is in the last. NaN doesn't count."""
    if not 2 <= bins <= 100:
        raise ValueError("bins must be 2 to 100")
    values = data.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    placed = values.select(low.alias("lo"), high.alias("hi"), "v").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long"))
    width = (F.first("hi") - F.first("lo")) / bins
    return placed.groupBy("bin").agg(F.round(F.first("lo") + F.col("bin") * width, 6).alias("low"), F.round(F.first("lo") + (F.col("bin") + 1) * width, 6).alias("high"), F.count(F.lit(1)).alias("n"))


def top_values(data: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """column, value, n, percent of the most frequent values, if there are at most min(50, 5 % of rows)."""
    counts = _long(data, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"))
    fit = whole.filter(F.col("kinds") <= F.least(F.lit(50.0), F.col("rows") * 0.05))
    ranked = counts.join(fit, "column").withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= k)
    return ranked.select("column", "value", "n", F.round(100.0 * F.col("n") / F.col("rows"), 2).alias("percent"))


def string_lengths(data: DataFrame, columns: list[str]) -> DataFrame:
    """column, shortest, longest, mean_length in characters."""
    n = F.char_length("value")
    return _long(data, columns, "string").groupBy("column").agg(F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 2).alias("mean_length"))


def temporal_resolution(data: DataFrame, column: str) -> DataFrame:
    """first, last, resolution: the kind of the median gap between distinct sorted times.

    Times are cut into days for the windows, so that no window holds the whole column.
    """
    seconds = data.select(F.unix_micros(F.col(column).cast("timestamp")).alias("t")).filter("t is not null").distinct().withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    firsts = seconds.groupBy("day").agg(F.min("t").alias("a")).select("day", F.lead("a").over(Window.partitionBy(F.lit(0)).orderBy("day")).alias("next_day"))
    following = F.coalesce(F.lead("t").over(Window.partitionBy("day").orderBy("t")), F.col("next_day"))
    gaps = seconds.join(firsts, "day").select((following - F.col("t")).alias("gap")).filter("gap is not null")
    # The median is under a bound if over half of the gaps are: counts tell, nothing is sorted.
    kind = F.lit("year")
    for least, name in ((31_536_000, "month"), (2_592_000, "week"), (604_800, "day"), (86_400, "hour"), (3_600, "minute"), (60, "second"), (1, "subsecond")):
        kind = F.when(2 * F.count_if(F.col("gap") < least * 1_000_000) > F.count(F.lit(1)), name).otherwise(kind)
    kind = gaps.agg(kind.alias("kind")).scalar()
    stamp = "yyyy-MM-dd HH:mm:ss"
    return data.agg(F.date_format(F.min(column), stamp).alias("first"), F.date_format(F.max(column), stamp).alias("last")).withColumn("resolution", kind)


def dates_in_strings(data: DataFrame, columns: list[str]) -> DataFrame:
    """column, is_date: over half of the strings parse as times."""
    return _long(data, columns, "string").groupBy("column").agg((F.avg(F.try_to_timestamp("value").isNotNull().cast("int")) > 0.5).alias("is_date"))


def types(data: DataFrame) -> DataFrame:
    """column, type of the schema: integer, float, boolean, datetime, string or unknown."""
    kinds = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "boolean": "boolean", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "string"}
    rows = [(c, "float" if t.startswith("decimal") else kinds.get(t, "unknown")) for c, t in data.dtypes]
    return data.sparkSession.createDataFrame(rows, "column string, type string")


def summaries(data: DataFrame, name: str) -> DataFrame:
    """column, summary: a sentence or more on each numeric, temporal or string column, over all rows.

    Nulls and their share, different values, then for numbers range, mean, median, deviation and
    quartiles, for times their span, for strings of few kinds the five most frequent, for other
    strings their lengths. Booleans and columns of unknown type have none.
    """
    kind = {r["column"]: r["type"] for r in types(data).collect()}  # a row a column
    of = lambda *kinds: [c for c in data.columns if kind[c] in kinds]
    spark, numbers, times, strings = data.sparkSession, of("integer", "float"), of("datetime"), of("string")
    if not numbers + times + strings:
        return spark.createDataFrame([], "column string, summary string")
    heads = spark.createDataFrame([(c, f"In dataset '{name}', column '{c}' ({kind[c]} type):") for c in numbers + times + strings], "column string, head string")
    rows = heads.join(null_profile(data.select(*numbers, *times, *strings)), "column")
    parts = [F.col("head"), F.when(F.col("nulls") > 0, F.format_string("Contains %d null values (%.1f%% of rows).", "nulls", "percent"))]
    parts.append(F.format_string("Has %d unique values.", "n_unique"))
    if numbers:
        at = quantiles(data, numbers, [0.25, 0.5, 0.75]).groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
        rows = rows.join(numeric_profile(data, numbers).join(at, "column"), "column", "left")
        text = "Range: %.2f to %.2f. Mean: %.2f, Median: %.2f, Std: %.2f. 25th percentile: %.2f, 75th percentile: %.2f."
        parts.append(F.when(F.col("min").isNotNull(), F.format_string(text, "min", "max", "mean", F.col("`0.5`"), "std", F.col("`0.25`"), F.col("`0.75`"))))
    if times:
        stamp = lambda f, c: F.date_format(f(c), "yyyy-MM-dd HH:mm:ss")
        spans = data.agg(F.array(*(F.struct(F.lit(c).alias("column"), stamp(F.min, c).alias("first"), stamp(F.max, c).alias("last")) for c in times)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        rows = rows.join(spans, "column", "left")
        parts.append(F.when(F.col("first").isNotNull(), F.format_string("Temporal column spanning %s to %s.", "first", "last")))
    if strings:
        shown = F.format_string("'%s' (%d, %.1f%%)", "value", "n", "percent")
        few = top_values(data, strings, 5).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value", shown.alias("t")))), lambda x: x["t"]).alias("top"))  # five a column
        rows = rows.join(few, "column", "left").join(string_lengths(data, strings), "column", "left")
        lengths = F.format_string("String lengths: min=%d, max=%d, avg=%.1f.", "shortest", "longest", "mean_length")
        parts.append(F.when(F.col("top").isNotNull(), F.concat(F.lit("Top values: "), F.array_join("top", ", "), F.lit("."))).when(F.col("shortest").isNotNull(), lengths))
    return rows.select("column", F.concat_ws(" ", *parts).alias("summary"))


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV: nulls are empty, values with commas, quotes or line ends stand in quotes."""
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', '""'), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat_ws(",", *quoted)
