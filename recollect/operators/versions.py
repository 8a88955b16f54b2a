"""Versioned resources: operation logs folded into revisions, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.shared import saved


def fold(log: DataFrame, key: str = "resource_id", order: str = "sequence") -> DataFrame:
    """Each accepted operation with its revision, and the revision it replaced.

    ``log`` has key, order, op (create, update, delete) and value. A create counts only where
    nothing lives, an update or delete only where something does: so of a resource's log those
    count that differ in kind from the last create or delete.
    """
    w = Window.partitionBy(key).orderBy(order)
    life = F.when(F.col("op") == "create", 1).when(F.col("op") == "delete", 0)
    before = F.coalesce(F.last(life, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    accepted = F.when(F.col("op") == "create", before == 0).otherwise(before == 1)
    kept = log.withColumn("_ok", accepted).filter("_ok").drop("_ok")
    return kept.withColumn("revision", F.row_number().over(w).cast("long"))


def heads(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the greatest revision of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(revision)).alias("h")).select(key, "h.*")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with rows of ``changes`` put in, or in place of those of their key."""
    return current.join(changes, key, "left_anti").unionByName(changes)


def etag(revision: Column, content: Column) -> Column:
    return F.concat(F.lit("vr-"), revision.cast("string"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 16))


def with_defaults(rows: DataFrame, kind: str = "note", importance: float = 0.5) -> DataFrame:
    """id, content_hash, type, importance, status, revision of new memories: id, content and, if known, type."""
    own = F.col("type") if "type" in rows.columns else F.lit(kind)
    return rows.select("id", F.sha2("content", 256).alias("content_hash"), own.alias("type"), F.lit(importance).alias("importance"), F.lit("active").alias("status"), F.lit(1).alias("revision"))


def append_memories(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` with the memories of ``new`` whose content isn't there yet."""
    return held.unionByName(with_defaults(new).join(held.select("content_hash"), "content_hash", "left_anti"))


#: Columns of a log of mutations, after its key and order.
MUTATION = ("operation_id", "request_hash", "action", "expected", "content", "logical_key", "owner")


def last_before(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of an earlier row of their key, as ``name``.

    Rows are cut into ranges of key and order, so that one key's rows are many tasks' work;
    what a key's earlier ranges end with is a row for each range that shares a key with
    another, twice the number of ranges at most.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = saved(rows.withColumn(name, value).repartitionByRange(ranges, key, order).withColumn("_range", F.spark_partition_id()), "versions-ranges")
    inside = Window.partitionBy("_range", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(key, "_range").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_end")).withColumn("_shared", F.count(F.lit(1)).over(Window.partitionBy(key)))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.filter("_shared > 1").select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = cut.withColumn(name, F.last(name, ignorenulls=True).over(inside))
    out = out.join(F.broadcast(carried), (out[key] == carried["_key"]) & (out["_range"] == carried["_of"]), "left")  # two rows a range at most
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_range", "_key", "_of", "_carried")


def _followers(ops: DataFrame, key: str, order: str) -> DataFrame:
    """key, from, to, operation_id: for each operation, were it accepted, the next one that would be, and that one's id.

    An operation's ETag is known from the one it expects, so what can follow it is the first
    later one that expects that ETag, on a resource in the state, of the key and owner that it
    leaves. Both kinds meet in windows of that ETag, so a resource's log is spread by its ETags.
    """
    to = F.struct(F.col(order).alias("to"), "operation_id")
    gives = ops.select(key, F.col("etag").alias("_tag"), (F.col("action") == "delete").alias("_dead"), "logical_key", "owner", order, F.when(F.lit(False), to).alias("_to"))
    takes = ops.filter("action <> 'create'").select(key, F.col("expected").alias("_tag"), (F.col("action") == "restore").alias("_dead"), "logical_key", "owner", order, to.alias("_to"))
    later = Window.partitionBy(key, "_tag", "_dead", "logical_key", "owner").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    met = gives.unionByName(takes).withColumn("_next", F.last("_to", ignorenulls=True).over(later))
    return met.filter("_to is null and _next is not null").select(key, F.col(order).alias("from"), "_next.to", "_next.operation_id")


def _reached(first: DataFrame, arcs: DataFrame, key: str) -> DataFrame:
    """key, to, operation_id: all that arcs lead to from ``first``, each step doubling the arcs' length."""
    found, step = saved(first, "versions-reached"), saved(arcs, "versions-arcs")
    while True:
        at, b = found.alias("at"), step.alias("b")
        new = saved(at.join(b, (F.col(f"at.{key}") == F.col(f"b.{key}")) & (F.col("at.to") == F.col("b.from"))).select(f"at.{key}", "b.to", "b.operation_id"), "versions-new")
        if new.isEmpty():
            return found
        found = saved(found.unionByName(new), "versions-reached")
        a = step.alias("a")
        step = saved(a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.to") == F.col("b.from"))).select(f"a.{key}", "a.from", "b.to", "b.operation_id"), "versions-arcs")


def _numbered(log: DataFrame) -> DataFrame:
    """``log`` with the revision and etag that each mutation would have, were it accepted; null for what can't be."""
    expected = F.regexp_extract("expected", r"^vr-(\d{1,18})-", 1)
    revision = F.when(F.col("action") == "create", F.when(F.col("expected") == "*", F.lit(1))).when(F.col("action").isin("replace", "delete", "restore") & (expected != ""), expected.cast("long") + 1)
    return log.withColumn("revision", revision.cast("long")).withColumn("etag", etag(F.col("revision"), F.col("content")))


def _chains(ops: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, operation_id of each mutation among ``ops`` (see ``_numbered``) that is accepted.

    Only a first creation starts a chain and no arc leads to a creation, so later ones, which find
    the resource there, are never reached.
    """
    ops = ops.filter("revision is not null")
    start = F.min(F.struct(F.col(order).alias("to"), "operation_id")).alias("_first")
    first = ops.filter("action = 'create'").groupBy(key).agg(start).select(key, "_first.to", "_first.operation_id")
    while True:
        chain = _reached(first, _followers(ops, key, order), key).withColumnRenamed("to", order)
        again = F.row_number().over(Window.partitionBy(key, "operation_id").orderBy(order)) > 1
        repeated = chain.filter("operation_id is not null").withColumn("_again", again).filter("_again").groupBy(key).agg(F.min(order).alias(order))
        repeated = saved(repeated, "versions-repeated")
        if repeated.isEmpty():
            return chain
        # what used an accepted operation's id with another request can't stand; what follows is found anew
        ops = saved(ops.join(repeated, [key, order], "left_anti"), "versions-log")


def accepted(log: DataFrame, key: str = "resource_id", order: str = "sequence") -> DataFrame:
    """key, order, MUTATION, revision, etag of each mutation that a log leads to; see ``mutate``."""
    ops = saved(_numbered(log.select(key, order, *MUTATION)).filter("revision is not null"), "versions-log")
    return ops.join(_chains(ops, key, order), [key, order], "left_semi")


def mutate(log: DataFrame, key: str = "resource_id", order: str = "sequence") -> DataFrame:
    """key, order, outcome, revision, etag: the answer to each mutation of a log.

    ``log`` has key, order (different for each of a key's rows) and MUTATION: operation_id is the
    idempotency key, null for none; action is create, replace, delete or restore; expected is the
    ETag that the writer saw, ``*`` for a creation; content is the state it leaves. The rules, in
    this order:

    - ``replayed``: the id was used by an accepted mutation of the resource with the same
      request_hash; the answer is that one's revision and ETag. ``conflict`` if the hash differs.
      A refused mutation doesn't use up its id.
    - A creation needs ``*`` (else ``precondition``) and that no revision is there, deleted or not
      (else ``conflict``).
    - Others need a resource (``not_found``), at the ETag they expect (``precondition``); a
      restoration needs a deleted one (``conflict``), the rest a living one (``not_found``);
      logical_key and owner never change (``conflict``).
    - Whatever else is ``accepted`` as the next revision, whose ETag tells number and content.

    Nothing is folded row by row: which mutation can follow which is found by their ETags, chains
    are followed by doubling, and a resource's log is never one task's work. An action of any
    other name is ``invalid``. A null request_hash equals only a null one.

    The log is numbered and written once. Then its rows are shuffled to those of their id, where
    the accepted mutations join them, and without what is settled there into ranges, see
    ``last_before``.
    """
    rows = saved(_numbered(log.select(key, order, *MUTATION)).drop("content"), "versions-log")
    chain = _chains(rows, key, order)
    mine = rows.select(key, order, "operation_id", "request_hash", "action", "expected", "revision", "etag", F.lit(False).alias("_hit"))
    met = mine.unionByName(chain.withColumn("_hit", F.lit(True)), allowMissingColumns=True)
    met = met.withColumn("_alone", F.when(F.col("operation_id").isNull(), F.col(order)))  # a column, or each window would shuffle by an expression of its own
    same_id = Window.partitionBy(key, "operation_id", "_alone").orderBy(order, F.desc("_hit"))
    met = met.withColumn("_mine", ~F.col("_hit") & F.coalesce(F.lag("_hit").over(same_id), F.lit(False)))  # a hit comes right before its own row
    answer = F.when(F.col("_mine"), F.struct("request_hash", "revision", "etag"))
    met = met.withColumn("_by_id", F.last(answer, ignorenulls=True).over(same_id.rowsBetween(Window.unboundedPreceding, -1))).filter("not _hit")
    by_id, create = F.col("_by_id"), F.col("action") == "create"
    settled = (
        F.when(by_id.isNotNull() & by_id["request_hash"].eqNullSafe(F.col("request_hash")), "replayed").when(by_id.isNotNull(), "conflict").when(F.col("_mine"), "accepted")
        .when(~F.coalesce(F.col("action").isin("create", "replace", "delete", "restore"), F.lit(False)), "invalid")
        .when(create & ~F.coalesce(F.col("expected") == "*", F.lit(False)), "precondition").when(create, "conflict")
    )
    told = lambda field: F.when(F.col("outcome") == "replayed", by_id[field]).when(F.col("outcome") == "accepted", F.col(field)).alias(field)
    open_ = lambda c: F.when(F.col("outcome").isNull(), c)
    met = met.withColumn("outcome", settled).select(key, order, "outcome", told("revision"), told("etag"), open_(F.col("expected")).alias("_expected"), open_(F.col("action") == "restore").alias("_restore"), F.when(F.col("outcome") == "accepted", F.col("action") == "delete").alias("_dead"))
    met = last_before(met, key, order, F.when(F.col("outcome") == "accepted", F.struct("etag", F.col("_dead").alias("deleted"))), "_head")
    head = F.col("_head")
    refused = (
        F.when(head.isNull(), "not_found").when(~F.coalesce(F.col("_expected") == head["etag"], F.lit(False)), "precondition")
        .when(F.col("_restore"), "conflict").when(head["deleted"], "not_found").otherwise("conflict")
    )
    return met.select(key, order, F.coalesce("outcome", refused).alias("outcome"), "revision", "etag")


def snapshots(log: DataFrame, key: str = "resource_id", order: str = "sequence") -> DataFrame:
    """key, revision, action, etag, content, logical_key, owner, deleted of every revision that a log leads to."""
    return accepted(log, key, order).select(key, "revision", "action", "etag", "content", "logical_key", "owner", (F.col("action") == "delete").alias("deleted"))


def without_evidence(evidence: DataFrame, log: DataFrame, key: str = "resource_id", order: str = "sequence") -> DataFrame:
    """``evidence`` with ``active``: false for what a replaced or deleted resource stood for."""
    changed = accepted(log, key, order).filter("action in ('replace', 'delete')").select(key).distinct().withColumn("_changed", F.lit(True))
    return evidence.join(changed, key, "left").withColumn("active", F.col("_changed").isNull()).drop("_changed")
