import random

from recollect.llm import decontaminate as dc


def distance(pattern, text):
    """Least edits of ``pattern`` to any part of ``text``: the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (90, 140))
        assert dc.myers(p, t)[0] == distance(p, t)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "#", text[i] + "#"]) + text[i + 1 :]
    return text


def test_leaks_against_brute_force(spark, small):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()][:8]
    filler = "lorem ipsum dolor sit amet consectetur " * 3
    docs = [(0, None), (1, ""), (2, filler)]
    for n, (_, t) in enumerate(items):
        k = int(dc.RATE * len(dc.normal(t)))
        for edits in (0, k // 2, k, 3 * k + 20):
            docs.append((len(docs), filler + edited(rng, t, edits).upper().replace(" ", " \n ") + filler))
    got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=400).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            x = distance(dc.normal(item), dc.normal(text))
            if x <= int(dc.RATE * len(dc.normal(item))):
                want[d, i] = x
    assert got == want and len(want) >= 16


def test_without_leaks_and_hard_cases(spark, hard, nothing):
    bench = spark.createDataFrame([(1, "the cat sat ON the mat. it was a good mat."), (2, None), (3, ""), (1, "the cat sat ON the mat. it was a good mat.")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    found = dc.leaks(hard, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(1, 1, 0), (2, 1, 0), (2, 1, 0)]
    kept = dc.without_leaks(hard, bench)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 3
    assert dc.leaks(nothing, bench).collect() == [] and dc.leaks(hard, bench.limit(0)).collect() == []
    assert dc.without_leaks(hard, bench.limit(0)).count() == hard.count()
