import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import language as lid


def all_segmentations(word, probs):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        p = 1.0
        for x in parts:
            p *= probs.get(x, lid.UNKNOWN if len(x) == 1 else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    probs = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): rng.random() for _ in range(20)}
    table, both = lid.lattice({p: (x, x / 2) for p, x in probs.items()}, 2)
    words = ["a", "abcabc", "abcb", "ccbax", "zzz"]
    at = lid.forward(words, table, both)
    for i, word in enumerate(words):
        assert math.isclose(at[i, len(word), 0], all_segmentations(word, probs), rel_tol=1e-9)
        assert math.isclose(at[i, len(word), 1], all_segmentations(word, {p: x / 2 for p, x in probs.items()}), rel_tol=1e-9)


def test_words_of_any_length_are_scored_whole():
    rng = random.Random(2)
    probs = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): rng.random() for _ in range(20)} | {"a": 0.1, "b": 0.1, "c": 0.1}
    table, both = lid.lattice({p: (x, x / 2) for p, x in probs.items()}, 2)
    for n in (1, 2, 7, 60):
        word = "".join(rng.choice("abcd") for _ in range(n))
        want = [math.log(x) for x in lid.forward([word], table, both)[0, n]]
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(lid.forward_long(word, table, both), want, strict=True))
    assert all(math.isfinite(x) for x in lid.forward_long("abc" * 5000, table, both))
    model = {"langs": ["x", "y"], "pieces": {p: (x, x / 2) for p, x in probs.items()}}
    assert lid.Scores(model).of([[lid.START + "ab" * 200, lid.START + "ab"]])[0].shape == (2,)


def test_expected_uses_cover_the_word():
    probs = {"a": 0.3, "b": 0.2, "ab": 0.4, "ba": 0.1}
    table, own = lid.lattice({p: (x,) for p, x in probs.items()}, 1)
    uses = lid.expected("abab", lid.forward(["abab"], table, own)[0, :, 0], table, own[:, 0].tolist())
    assert math.isclose(sum(len(p) * x for p, x in uses), 4.0)


def test_held_out_is_crc32(spark):
    ids = [*range(50), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", lid.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_accuracy_on_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_inputs_are_texts_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = lid.fit(docs)
    a = lid.predict(docs, model).collect()
    b = lid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).collect()
    assert sorted(a) == sorted(b)


def test_hard_cases(spark, hard, nothing):
    rows = lid.identify(spark, hard).collect()
    assert len(rows) == hard.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[6].lang_pred in ("en", "fr", "de")
    assert lid.identify(spark, nothing).collect() == []


@pytest.mark.parametrize("text", [None, "", "123 456 !!", "_ _", "½ ² ①"])
def test_no_letters(text):
    assert lid.words(text) == []
