"""Homomorphic multiset fingerprints of documents.

Only DataFrame functions: no Python runs on the executors.

A text is cut into paragraphs, and those into pieces: at a line end, at a sentence's end or a cell
bar and a space, and, where none comes for 16 characters, after the next word that ends in one of
a few letters, so that the cuts follow the content; where no such word comes for 160 characters,
there. Paragraphs are what blank lines part, and are cut one by one; blanks around a piece don't
count, and a piece of blanks alone is none. A piece is hashed to a wide vector, and a text's
fingerprint is the sum of its pieces' vectors, each lane modulo a power of two. So it doesn't
depend on the order of paragraphs, equal multisets have equal fingerprints, and a paragraph is
put in or taken out by adding or subtracting its vectors (``insert``, ``delete``), wherever it
stands.

Lanes: one counts pieces (mod 2^32); 4 dense lanes of 32 bits hold sums of hashes and tell
different multisets apart; LEVELS of 32 sparse lanes of 15 bits serve likeness: a piece
adds to one lane of level 0, and with a chance of 1/4 each to one of the next level too. Four
sparse lanes are summed as one number modulo 2^60, so an overflow carries. The share
of lanes in which two fingerprints differ tells how many pieces differ; the finest level that
isn't saturated is used; the last isn't with 10 million differing pieces, so that a text of a
gigabyte is told as well as a short one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import saved

DENSE, LEVELS, LANES = 4, 10, 32
#: Share of differing lanes above which a level is saturated.
FULL = 0.92
#: Sparse lanes that are summed as one number, and the bits of each.
PACKED, BITS = 4, 15
SPARSE = LANES // PACKED
WIDTH = 1 + DENSE + LEVELS * SPARSE
#: A piece: to the next line end or sentence's end, but from 16 characters on also to the next
#: word that ends in one of some letters, and to 160 characters at most.
ENDS = r"(?<=\n)(?!\n)|(?<=[.!?|] )|\z"
PIECE = rf"(?s).{{1,16}}?(?:{ENDS})|.{{16,160}}?(?:{ENDS}|(?<=[dnrsy] ))|.{{1,160}}"
#: Modulus of each lane, as a mask.
MASKS = [(1 << 32) - 1] * (1 + DENSE) + [(1 << (BITS * PACKED)) - 1] * (LEVELS * SPARSE)
#: Stands for a null doc_id, which sorts first.
NONE = -(2**63)
#: Rows of ids that one window of the successor search takes on average.
BLOCK = 50_000


def pieces(text: Column) -> Column:
    """The pieces of each paragraph; no piece reaches over a blank line."""
    cut = F.flatten(F.transform(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))))
    return F.filter(F.transform(cut, lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + value(x))


def sparse_lanes(hashes: Column) -> Column:
    """SPARSE sums of PACKED lanes: a hash adds its bits 8 to 15, made odd, to the lane that its low bits name."""
    places = F.array(*(F.lit(1 << (BITS * i)).cast("long") for i in range(PACKED)))
    modulus = F.lit(MASKS[-1]).cast("long")

    def value(h: Column) -> Column:
        v = F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(0xFF)).bitwiseOR(F.lit(1))
        return v * F.get(places, F.shiftrightunsigned(h, 3).bitwiseAND(F.lit(PACKED - 1)).cast("int"))

    def lane(i: Column) -> Column:
        own = F.filter(hashes, lambda h: h.bitwiseAND(F.lit(SPARSE - 1)) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, h: (a + value(h)).bitwiseAND(modulus))

    return F.transform(F.sequence(F.lit(0), F.lit(SPARSE - 1)), lane)


def levels(hashes: Column, level: int = 0) -> Column:
    """The sparse lanes of ``level`` and of the levels above, each of a quarter of the hashes before."""
    own = sparse_lanes(hashes)
    if level == LEVELS - 1:
        return own
    above = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 40 + 2 * level).bitwiseAND(F.lit(3)) == 0)
    zeros = F.array_repeat(F.lit(0).cast("long"), SPARSE * (LEVELS - 1 - level))
    return F.concat(own, let(above, lambda h: F.when(F.size(h) == 0, zeros).otherwise(levels(h, level + 1))))


def lanes(text: Column) -> Column:
    """array<bigint> of WIDTH lanes: the sum of the vectors of the text's pieces."""

    def low(h: Column) -> Column:
        return h.bitwiseAND(F.lit(0xFFFFFFFF))

    def high(h: Column) -> Column:
        return F.shiftrightunsigned(h, 32)

    def summed(ps: Column) -> Column:
        seeded = F.transform(ps, lambda p: F.xxhash64(p, F.lit(1)))
        second = let(seeded, lambda g: F.array(total(g, low), total(g, high)))
        first = lambda h: F.array(F.size(ps).cast("long"), total(h, low), total(h, high))
        return let(F.transform(ps, lambda p: F.xxhash64(p)), lambda h: F.concat(first(h), second, levels(h)))

    return modulo(let(pieces(text), summed))


def modulo(vector: Column) -> Column:
    return F.zip_with(vector, F.array(*(F.lit(m).cast("long") for m in MASKS)), lambda x, m: x.bitwiseAND(m))


def insert(vector: Column, text: Column) -> Column:
    """The lanes after the pieces of ``text`` are put in."""
    return modulo(F.zip_with(vector, lanes(text), lambda a, b: a + b))


def delete(vector: Column, text: Column) -> Column:
    """The lanes after the pieces of ``text``, which were in, are taken out."""
    return modulo(F.zip_with(vector, lanes(text), lambda a, b: a - b))


def to_hex(vector: Column) -> Column:
    """The fingerprint as lower-case hex: 8 digits for each of the first lanes, then 15."""
    digits = lambda first, n, size: F.transform(F.slice(vector, first, n), lambda x: F.lpad(F.lower(F.hex(x)), size, "0"))
    return F.concat(F.array_join(digits(1, 1 + DENSE, 8), ""), F.array_join(digits(2 + DENSE, LEVELS * SPARSE, BITS * PACKED // 4), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: about 2 x the common pieces over the pieces of both, from two lane arrays.

    1 if all lanes agree. With u the share of lanes that differ, -m ln(1 - u) pieces differ.
    """
    pieces_of_both = F.element_at(a, 1) + F.element_at(b, 1)

    def apart(x: Column, y: Column) -> Column:
        lane = lambda v, i: F.shiftrightunsigned(v, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))
        return reduce(add, ((lane(x, i) != lane(y, i)).cast("int") for i in range(PACKED)))

    def estimate(differ: Column) -> Column:
        """Of the lanes' differences: the pieces that differ, by the finest level that isn't saturated."""

        def share(level: int) -> Column:
            return F.aggregate(F.slice(differ, 1 + level * SPARSE, SPARSE), F.lit(0), lambda s, x: s + x) / F.lit(float(LANES))

        def count(level: int, u: Column) -> Column:
            return F.lit(-float(LANES * 4**level)) * F.log(F.lit(1.0) - F.least(u, F.lit(1 - 0.5 / LANES)))

        def by_shares(u: Column) -> Column:
            out = count(LEVELS - 1, F.get(u, LEVELS - 1))
            for level in reversed(range(LEVELS - 1)):
                out = F.when(F.get(u, level) <= FULL, count(level, F.get(u, level))).otherwise(out)
            least = F.least(count(0, F.get(u, 0)), pieces_of_both.cast("double"))
            return F.when(F.get(u, 0) > FULL, F.greatest(out, least)).otherwise(out)

        return let(F.array(*map(share, range(LEVELS))), by_shares)

    sparse = lambda v: F.slice(v, 2 + DENSE, LEVELS * SPARSE)
    found = F.lit(1.0) - let(F.zip_with(sparse(a), sparse(b), apart), estimate) / pieces_of_both
    return F.when((a == b) | (pieces_of_both == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def successors(ids: DataFrame, key: str = "k") -> DataFrame:
    """key, next_key for each distinct ``key`` (bigint): the next larger one, the least after the last.

    Windows see ranges of about BLOCK ids, whatever their spread, then one id a range.
    """
    ids = saved(ids.select(key).distinct(), "fingerprint-ids")
    n, low = ids.agg(F.count(F.lit(1)), F.min(key)).first()
    ranges = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BLOCK)
    ids = saved(ids.repartitionByRange(ranges, key).withColumn("block", F.spark_partition_id()), "fingerprint-ranges")
    firsts = ids.groupBy("block").agg(F.min(key).alias("first"))
    firsts = firsts.select("block", F.coalesce(F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("block")), F.lit(low)).alias("next_first"))
    inside = ids.withColumn("next_in", F.lead(key).over(Window.partitionBy("block").orderBy(key)))
    return inside.join(firsts, "block").select(key, F.coalesce("next_in", "next_first").alias("next_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text's lanes as ``lanes`` and ``fingerprint``, for every row of ``docs``."""
    with_lanes = docs.select("doc_id", lanes(F.coalesce("text", F.lit(""))).alias("lanes"))
    return with_lanes.withColumn("fingerprint", to_hex(F.col("lanes")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of an edited text and of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    of the next document, in ascending doc_id; the first follows the last.

    Null text counts as empty; an empty text has a fingerprint of zeros. Rows with one doc_id
    each get a result, and the next document is then the row of the next larger doc_id that
    has the least text; a null doc_id sorts first. A single document is its own next. Other
    columns are ignored. The whole text is shuffled once by doc_id; the next document is
    joined by id and only the part that its predecessor needs is sent on. A very long text has
    more pieces, summed in one row's task.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))  # one shuffle serves both joins
    needs = saved(base.groupBy("k").agg(F.floor(F.max(F.length("text")) / 4).cast("int").alias("need")), "fingerprint-needs")
    after = needs.join(successors(needs), "k").select(F.col("next_key").alias("k"), F.col("k").alias("before"), "need")
    given = base.join(after.hint("shuffle_hash"), "k")
    first = F.row_number().over(Window.partitionBy("k", "before").orderBy("text"))
    given = given.withColumn("first", first).filter("first = 1")
    given = given.select(F.col("before").alias("k"), F.substring("text", F.lit(1), F.col("need")).alias("patch"), lanes(F.col("text")).alias("next_lanes"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("patch", F.lit(1), cut))
    rows = base.join(given.hint("shuffle_hash"), "k").select(F.nullif("k", F.lit(NONE)).alias("doc_id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_lanes")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), lanes(F.col("text")).alias("a"), lanes(F.col("edited")).alias("b"), "next_lanes")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("a")).alias("fingerprint"), to_hex(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_lanes")).alias("near_next"),
    )
