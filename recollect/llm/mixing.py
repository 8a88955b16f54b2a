"""Mixing sources to target weights by weighted fair queueing.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import fresh, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source's shuffled order, by three hex digits of the key.
PARTS = 4096
#: Words that are queued at once, and copies of documents that a range of the order holds.
PACKET, RANGE = 256, 100_000


def source_targets(sources: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``target``, the words each source gives to the mix.

    ``sources`` has a row per source: source, skey, source_size. They take the weights in
    turn, by code point, null last, and share ``share`` x all words; none gets over
    ``epochs`` x its own, and what that leaves is shared again by weight. The fixed point is
    a water level: sources in order of their cap over their weight are full until the level
    falls short of the next one's cap. The windows see one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    filling = everything.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything).cast("double") * F.lit(float(share))
    levels = weighed.withColumn("level", (budget - before) / left).withColumn("n", F.row_number().over(filling))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    level = F.min_by("level", F.when(~full, F.col("n"))).over(everything)
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return levels.withColumn("full", full).withColumn("water", level).withColumn("target", target).drop("cap", "level", "n", "full", "water")


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix", budget: int | None = None, packet: int = PACKET) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, virtual_finish of every row of ``docs``.

    Each source is shuffled by the MD5 of seed and doc_id and queued ``epochs`` times. A document
    is queued in packets of ``packet`` words, so that a very long one can't overdraw its source.
    A packet's virtual finish time is the source's words up to its end, over the source's target.
    The packets of all sources are sorted by it, in ranges, and the mix ends where their words
    reach ``budget`` (default: ``share`` x all words); the packet there is taken in part.
    ``virtual_finish`` is that of the document's first copy.

    Running sums take two steps, over parts and inside a part: of a source's shuffled order, cut
    in ``PARTS`` parts, and of the global order, cut in ranges. So no window sees a whole source.

    Null text has size 0; size 0 rows stay with taken 0. Null sources make one source, null
    doc_ids sort as an empty id. Repeated rows are separate documents of the queue, rows of one
    doc_id too; ``text_key``, the text's hash, tells these apart. A very long text is more packets.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    part = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), skey.alias("skey"), size.alias("size"), key.alias("key")).withColumn("part", part)
    rows = saved(rows, "mix-rows")
    everything = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("rows"))
    words, n_rows = everything.first()
    if budget is None:
        budget = int(share * words)

    parts = rows.groupBy("skey", "part").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sources = source_targets(parts.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), share, epochs, weights)
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.drop("source").withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    parts = parts.join(sources.select("skey", "source_size", "target"), "skey")

    inside = Window.partitionBy("skey", "part").orderBy("key", "doc_id", "size")
    placed = rows.withColumn("n", F.row_number().over(inside)).withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(parts, ["skey", "part"])
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, epochs - 1).otherwise(0))))
    queued = copies.withColumn("packet", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / packet) - 1).cast("int"))))
    upto = F.least(F.col("size"), (F.col("packet") + 1) * F.lit(packet))
    served = F.col("before") + F.col("within") + F.col("epoch") * F.col("source_size") + upto
    queued = queued.withColumns({"words": upto - F.col("packet") * F.lit(packet), "finish": F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(1.0))})

    order = ["finish", "skey", "key", "n", "epoch", "packet"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), epochs * n_rows // RANGE)
    queued = queued.drop("before", "within").repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    queued = saved(queued, "mix-order")
    firsts = queued.groupBy("range").agg(F.sum("words").alias("w"))
    firsts = firsts.select("range", F.coalesce(F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone"))
    ahead = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = queued.withColumn("inside", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(F.broadcast(firsts), "range")  # a row a range
    ranked = ranked.withColumn("t", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("gone") - F.col("inside"))).cast("long"))
    kept = ("doc_id", "text_key", "source", "size", "source_size", "target")
    out = ranked.groupBy("skey", "part", "n").agg(*(F.first(c).alias(c) for c in kept), F.sum("t").alias("taken"), F.max(F.when(F.col("epoch") == 0, F.col("finish"))).alias("virtual_finish"))
    return out.select(*kept, "taken", "virtual_finish")


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, and how many: columns size, source_size, target, taken.

    A row is told by doc_id, source and its text's hash, repeated rows by their number. Columns
    of ``docs`` with one of the four names give way to them. Options as for ``mix``.
    """
    key, n = fresh(docs, "text_key", "copy")
    same = lambda doc, of: Window.partitionBy("doc_id", "source", of).orderBy(doc)
    added = ["size", "source_size", "target", "taken"]
    rows = docs.drop(*added).withColumn(key, F.xxhash64("text")).withColumn(n, F.row_number().over(same(F.lit(0), key)))
    takes = mix(docs, **options).withColumn("copy", F.row_number().over(same("taken", "text_key")))
    takes = saved(takes.filter("taken > 0"), "mix-takes").withColumnsRenamed({"doc_id": "_doc", "source": "_source", "copy": "_copy", "text_key": "_text"}).select("_doc", "_source", "_copy", "_text", *added)
    on = rows["doc_id"].eqNullSafe(takes["_doc"]) & rows["source"].eqNullSafe(takes["_source"]) & (rows[key] == takes["_text"]) & (rows[n] == takes["_copy"])
    return rows.join(takes, on).select(*(rows[c] for c in docs.columns if c not in added), *(takes[c] for c in added))
