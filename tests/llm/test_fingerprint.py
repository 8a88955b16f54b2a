import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from recollect.llm import fingerprint as fp


def one(spark, text):
    return spark.range(1).select(fp.lanes(F.lit(text)).alias("v")).first().v


def test_order_independent_and_incremental(spark):
    assert one(spark, "a. b. c. ") == one(spark, "c. a. b. ") != one(spark, "c. a. b. b. ")
    df = spark.range(1).select(fp.lanes(F.lit("a. b. ")).alias("v"))
    added = df.select(fp.insert(F.col("v"), F.lit("c. ")).alias("v"))
    assert added.first().v == one(spark, "a. b. c. ")
    assert added.select(fp.delete(F.col("v"), F.lit("a. b. "))).first()[0] == one(spark, "c. ")


def test_paragraphs_in_any_order_put_in_and_taken_out(spark):
    parts = [f"Paragraph {i} says a few words. It says them twice,\nand ends without a stop" + " or so" * i for i in range(5)]
    whole = one(spark, "\n\n".join(parts))
    assert whole == one(spark, "\n\n".join(reversed(parts))) == one(spark, "\n \n".join([*parts[2:], *parts[:2]]) + "\n")
    assert one(spark, "A\n\nB") == one(spark, "B\n\nA") != one(spark, "A\n\nB\n\nB")
    df = spark.createDataFrame([(whole,)], "v array<long>")
    without = df.select(fp.delete(F.col("v"), F.lit(parts[2])).alias("v"))
    assert without.first().v == one(spark, "\n\n".join(parts[:2] + parts[3:]))
    assert without.select(fp.insert(F.col("v"), F.lit(parts[2])).alias("v")).first().v == whole


def test_the_whole_query_against_multisets(spark, small):
    """near_edited and near_next are about twice the common pieces over all, with ids and hashes exact."""
    from recollect.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    order = sorted(docs)
    off = []
    for r in QUERIES["op7_fingerprints"](spark, small).collect():
        text, after = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = Counter(cut(text)), Counter(cut(other))
            total = sum(a.values()) + sum(b.values())
            off.append(abs(near - (2 * sum((a & b).values()) / total if total else 1)))
    assert sum(off) / len(off) < 0.12 and sorted(off)[int(0.95 * len(off))] < 0.5  # 32 lanes a level: an estimate


def test_edited(spark, hard):
    rows = fp.edited_fingerprints(hard).collect()
    ids = sorted({r.doc_id for r in hard.collect() if r.doc_id is not None})
    texts = {}
    for r in hard.collect():
        texts[r.doc_id] = min(texts.get(r.doc_id, r.text or ""), r.text or "")
    order = [None, *ids]
    assert len(rows) == hard.count()
    for r in rows:
        text, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(cut(text)) == sorted(cut(edited)))
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1


def test_likeness(spark):
    a = " ".join(f"Sentence {i}." for i in range(400))
    b = " ".join(f"Sentence {i}." for i in range(100, 500))
    v, w = one(spark, a), one(spark, b)
    near = spark.createDataFrame([(v, w)], "a array<long>, b array<long>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
    assert 0.6 < near < 0.9


def cut(text):
    """Pieces of a text, by hand: those of its paragraphs, without the blanks around them."""
    return [p for part in re.split(r"\n[ \t\r]*\n\s*", text) for p in (x.strip(" \t\r\n") for x in cut_paragraph(part)) if p]


def cut_paragraph(text):
    out, at = [], 0
    strong = lambda i: i == len(text) or (text[i - 1] == "\n" and text[i] != "\n") or (text[i - 1] == " " and i > 1 and text[i - 2] in ".!?|")
    while at < len(text):
        ends = [i for i in range(at + 1, min(len(text), at + 16) + 1) if strong(i)]
        if not ends:
            ends = [i for i in range(at + 16, min(len(text), at + 160) + 1) if strong(i) or (text[i - 1] == " " and text[i - 2] in "dnrsy")]
        end = ends[0] if ends else min(len(text), at + 160)
        out.append(text[at:end])
        at = end
    return out


def by_hand(spark, text):
    ps = cut(text)
    rows = spark.createDataFrame([(p,) for p in ps], "p string").select(F.xxhash64("p").alias("h"), F.xxhash64("p", F.lit(1)).alias("g")).collect()
    m = 2**64 - 1
    out = [len(ps)] + [sum(x) % 2**32 for x in zip(*((r.h & 0xFFFFFFFF, (r.h & m) >> 32, r.g & 0xFFFFFFFF, (r.g & m) >> 32) for r in rows), strict=True)]
    for level in range(fp.LEVELS):
        sums = [0] * fp.SPARSE
        for r in rows:
            h = r.h & m
            if (h >> 40) & (4**level - 1) == 0:
                sums[h & 7] += (((h >> 8) & 0xFF) | 1) << (15 * ((h >> 3) & 3))
        out += [s % 2**60 for s in sums]
    return out


def test_lanes_against_sums_by_hand(spark):
    prose = " ".join(f"word{i * 7 % 97}s and" + ". " * (i % 9 == 0) + "\n" * (i % 31 == 0) for i in range(400))
    for text in ("a", prose, "x" * 1000, prose[:333] + "y" * 500):
        assert one(spark, text) == by_hand(spark, text)


def test_texts_without_sentences_are_told(spark):
    words = [f"w{i * i % 9973}{'dnrsytaeo'[i % 9]}" for i in range(3000)]
    long, other = " ".join(words), " ".join(f"q{i * i % 9949}s" for i in range(3000))
    rows = [(1, long), (2, other), (3, "".join(words)), (4, "".join(f"{i * i % 99991:x}" for i in range(900)))]
    out = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.near_edited >= 0.4 and r.near_edited > r.near_next + 0.1 for r in out.values())


def test_very_long_unrelated_texts_are_apart(spark):
    texts = [" ".join(f"Sentence {k}{i}." for i in range(40000)) for k in "ab"]
    v, w = (one(spark, t) for t in texts)
    near = spark.createDataFrame([(v, w)], "a array<long>, b array<long>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
    assert near < 0.5


def test_own_edit_is_nearer_than_the_next_document(spark, small):
    rows = fp.edited_fingerprints(spark.read.parquet(f"{small}/documents.parquet")).filter("n_chars >= 40").collect()
    assert sum(r.near_edited >= r.near_next for r in rows) / len(rows) > 0.97  # some are followed by a near copy
    assert sum(r.near_edited >= 0.5 for r in rows) / len(rows) > 0.9


def test_single_and_empty(spark, nothing):
    assert fp.edited_fingerprints(nothing).collect() == []
    r = fp.edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
