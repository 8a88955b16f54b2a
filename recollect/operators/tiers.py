"""Sweeps of memories into the archive, workspace by workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.listing import top_of


def sweep(memories: DataFrame, overrides: DataFrame, threshold: float = 0.5, batch: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a sweep would archive (workspace, id, importance), and its report: workspace, candidates, archived, error.

    ``overrides`` has workspace, enabled and threshold, of workspaces that differ: null fields
    stand for the rule of all (enabled, ``threshold``). A workspace that is off is swept of
    nothing. A threshold that isn't from 0 to 1 is that workspace's error; the others go on. Of
    the memories of active status at the threshold or under it a workspace gives the ``batch``
    least important, equal ones by id.
    """
    rules = overrides.groupBy("workspace").agg(F.first("enabled").alias("enabled"), F.first("threshold").alias("own"))
    known = memories.select("workspace").distinct().join(rules, "workspace", "left")
    own = F.coalesce("own", F.lit(threshold))
    wrong = ~own.between(0.0, 1.0) | F.isnan(own)
    known = known.select("workspace", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.when(wrong, F.format_string("threshold %.2f is not from 0 to 1", own)).alias("error"), own.alias("own"))
    swept = known.filter("enabled and error is null").select("workspace", "own")
    candidates = memories.join(swept, "workspace").filter("status = 'active' and importance <= own").select("workspace", "id", "importance")
    taken = top_of(candidates, ["workspace"], [F.asc("importance"), F.asc("id")], batch).drop("rank")
    counts = candidates.groupBy("workspace").agg(F.count(F.lit(1)).alias("candidates"))
    report = known.join(counts, "workspace", "left").select("workspace", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.least(F.coalesce("candidates", F.lit(0)), F.lit(batch)).alias("archived"), F.when(F.col("enabled"), F.col("error")).alias("error"))
    return taken, report
