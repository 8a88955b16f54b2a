import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import brown
from recollect.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def likelihood(texts, cls):
    """Of the classes alone, as sums over a bigram's counts."""
    pairs, left, right = Counter(), Counter(), Counter()
    for t in texts:
        before = brown.END
        for w in t:
            c = cls[w]
            pairs[before, c] += 1
            left[before] += 1
            right[c] += 1
            before = c
    mass = lambda n: n * math.log(n)
    return sum(map(mass, pairs.values())) - sum(map(mass, left.values())) - sum(map(mass, right.values()))


def classes_of(model):
    """Each clustered word's class, read back from the chunks."""
    listed = model["chunks"].select("chunk", F.posexplode("words").alias("at", "word"))
    own = model["known"].select("chunk", F.explode(F.arrays_zip("own", "wid")).alias("x")).select("chunk", F.col("x.own").alias("own"), F.col("x.wid").alias("wid"))
    found = listed.join(own, (listed["chunk"] == own["chunk"]) & (listed["at"] + 1 == own["own"])).select("word", "wid").distinct().collect()
    assert len({r.word for r in found}) == len({r.wid for r in found}) == len(found), "a word has one id in all chunks"
    return {r.word: int(model["classes"].of(np.array([r.wid]))[0]) for r in found}


def check(rows, found, model=None):
    """Every count and the base against plain loops; the score too, given the model."""
    texts = [(i, words(t)) for i, t in rows]
    c = Counter(w for i, t in texts if not out(i) for w in t)
    total, size = sum(c.values()), len(c)
    base = {w: (c[w] + 1) / (total + size + 1) for _, t in texts for w in t}
    expected = sorted((str(i), out(i), len(t), sum(w in c for w in t), total, round(sum(math.log10(base[w]) for w in t), 6)) for i, t in texts)
    assert expected == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    if model is None:
        return
    clustered = classes_of(model)
    cls = {w: brown.END if w is None else clustered.get(w, min(brown.RARE - 1 + int(math.log2(c[w])), brown.FIRST - 1) if c[w] > 1 else brown.ONCE) for w in base}
    m = np.zeros((model["k"], model["k"]))
    for i, t in texts:
        if not out(i):
            for a, b in zip([None, *t[:-1]], t, strict=True):
                m[cls[a], cls[b]] += 1
    assert (m == model["m"]).all()
    once, twice = (sum(n == k for w, n in c.items() if w is not None) for k in (1, 2))
    assert (once, twice, size) == (model["once"], model["twice"], model["words"] + (model["ends"] > 0))
    after, keep = brown.probabilities(m, once, twice)
    emitted = {w: (keep / ((1 + keep) * once) if c[w] else 1 / (1 + keep)) if cls[w] == brown.ONCE else c[w] / m[:, cls[w]].sum() for w in base}
    p = lambda a, b: brown.SHARE * after[cls[a], cls[b]] * emitted[b] + (1 - brown.SHARE) * base[b]
    scores = sorted((str(i), round(sum(math.log10(p(a, b)) for a, b in zip([None, *t[:-1]], t, strict=True)), 6)) for i, t in texts)
    assert scores == sorted((str(r.doc_id), round(r.score, 6)) for r in found)
    unknown = "\n"
    cls[unknown], base[unknown], emitted[unknown] = brown.ONCE, 1 / (total + size + 1), 1 / (1 + keep)
    for before in [None, unknown, *list(c)[:5]]:
        assert math.isclose(sum(p(before, w) for w in [*c, unknown]), 1, rel_tol=1e-9)


def test_the_whole_query_against_plain_loops(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = QUERIES["op13_scores"](spark, small).collect()
    model = brown.fit(docs)
    check(rows, found, model)
    fewer = brown.fit(docs, share=1e-3)
    assert fewer["least"] == math.ceil(1e-3 * model["tokens"]) and 0 < fewer["known"].select(F.explode("wid")).distinct().count() <= 1000
    assert model["likelihood"] == sorted(model["likelihood"]) and len(model["likelihood"]) > 1, "each round raises the likelihood"
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_a_round_of_exchange_by_recounting_everything():
    """Without a word next to itself, the gain of each class is how the whole likelihood changes."""
    near = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [[str(w) for w in near.permutation(vocabulary)[: near.integers(4, 12)]] + [None] for _ in range(60)]
    cls = {w: brown.FIRST + i % 3 for i, w in enumerate(vocabulary)} | {None: brown.END}
    k = brown.FIRST + 3
    m = np.zeros((k, k))
    before, after = {w: np.zeros(k) for w in vocabulary}, {w: np.zeros(k) for w in vocabulary}
    for t in texts:
        for a, b in zip([None, *t[:-1]], t, strict=True):
            m[cls[a], cls[b]] += 1
            if b:
                before[b][cls[a]] += 1
            if a:
                after[a][cls[b]] += 1
    to = brown.Exchange(m).best(np.array(list(before.values())), np.array(list(after.values())), np.array([cls[w] for w in vocabulary]))
    agree = 0
    for w, found in zip(vocabulary, to, strict=True):
        by = {c: likelihood(texts, cls | {w: c}) for c in range(brown.FIRST, k)}
        agree += max(by, key=by.get) == found
        assert by[found] >= by[cls[w]] - 0.05 * abs(max(by.values()) - min(by.values())) - 2.0
    assert agree >= 9


def test_pairs_add_up_with_counts_over_a_byte():
    near = np.random.default_rng(4)
    rows, ctx = np.r_[np.zeros(700, int), near.integers(0, 5, 900)], np.r_[np.full(700, 3), near.integers(0, 9, 900)]
    column = brown._pairs(rows, ctx, 6, 9)
    got = brown._unpaired(column, np.array([0, 1, 2, 3, 4, 4]), 5, 9)
    expected = np.zeros((5, 9))
    np.add.at(expected, (rows, ctx), 1)
    assert (got == expected).all() and len(column[5].as_py()) == 0
    assert (brown._unpaired(column.slice(1, 3), np.arange(3), 3, 9) == expected[1:4]).all()


def test_chunks_batches_and_partitions_change_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 80")
    key = lambda df: sorted((r.doc_id, round(r.score, 9), round(r.base_score, 9)) for r in df.collect())
    one = key(brown.score(spark, docs))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert key(brown.score(spark, docs.repartition(5))) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_more_tasks_and_chunks_change_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 80")
    key = lambda df: sorted((r.doc_id, round(r.score, 9), round(r.base_score, 9)) for r in df.collect())
    one = key(brown.score(spark, docs))
    monkeypatch.setattr(brown, "WORDS", 40)
    monkeypatch.setattr(brown, "DOCUMENTS", 9)
    assert key(brown.score(spark, docs)) == one


def test_all_words_but_those_met_once_are_clustered(spark):
    """In a corpus of any size: the words met 2 and 4 times are under a millionth of 4.2 million tokens."""
    texts = ["w " * 4_200_000, "seldom x seldom y", *["rare w"] * 4]
    ids = [i for i in range(40) if not out(i)][: len(texts)]
    model = brown.fit(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    found = classes_of(model)
    assert set(found) == {"w", "seldom", "rare"} and min(found.values()) >= brown.FIRST and (model["once"], model["twice"]) == (2, 1)


@pytest.mark.parametrize("least", [1, 3])
def test_hard_cases(spark, hard, nothing, least):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    model = brown.fit(hard, least=least, classes=4)
    check(rows, brown.score(spark, hard, least=least, classes=4).collect(), model if least > 1 else None)
    assert brown.score(spark, nothing).collect() == []


def test_nothing_learned_from(spark):
    ids = [i for i in range(40) if out(i)]
    found = brown.score(spark, spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(3, 0, 0, 0.0, 0.0)] * len(ids)
