import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from recollect.llm.common import saved


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    out = cp.run(spark, small)
    assert 0 < out.count() <= counts[-1]
    assert out.filter("taken > 2 * size or taken < 1 or text is null").count() == 0


def test_hard_cases(spark, hard, small):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, docs, small), f"hard-{name}")
    assert docs.count() > 0
    empty = hard.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in cp.STAGES:
        empty = saved(stage(spark, empty, small), f"empty-{name}")
    assert empty.count() == 0


def test_columns_with_names_of_the_stages_own(spark, hard, small):
    names = ["score", "lang_pred", "text_key", "key", "_key", "_k", "_flags", "flags", "none", "copy", "doc", "_whole_text", "n", "range"]
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(1) for c in names})
    for name, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, small), f"clash-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    assert set(names) <= set(saved(cp.STAGES[-1][1](spark, docs, small), "clash-mixing").columns)


def distance(item, text):
    """Least edits of an item to any part of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def by_hand(rows, items, shares=(3, 1, 2)):
    """(doc_id, taken) of near copies, benchmark items and mixing, by all pairs and plain loops."""
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    up = {d: d for d, _, _ in rows}
    sets = {d: grams(t) for d, t, _ in rows}
    for d in sorted(sets):
        for e in sorted(sets):
            if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                low, high = sorted((up[d], up[e]))
                up = {k: low if v == high else v for k, v in up.items()}
    kept = [r for r in rows if up[r[0]] == r[0]]
    plain = lambda t: " ".join(t.lower().split())
    kept = [r for r in kept if all(distance(plain(i), plain(r[1])) > int(0.08 * len(plain(i))) for i in items)]
    sources = sorted({s for *_, s in kept})
    size = {s: sum(len(t.split()) for _, t, o in kept if o == s) for s in sources}
    target, full = {}, set()
    while True:
        weights = {s: shares[i % 3] for i, s in enumerate(sources) if s not in full}
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weights[s] / sum(weights.values()) for s in sources}
        over = {s for s in sources if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    queue = []
    for s in sources:
        at = 0
        order = sorted((r for r in kept if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest())
        for _ in range(2):
            for d, t, _ in order:
                n = len(t.split())
                for begin in range(0, n, 256):
                    end = min(n, begin + 256)
                    queue.append(((at + end) / target[s], s, d, end - begin))
                at += n
    budget, taken = int(1.5 * sum(size.values())), {}
    for _, _, d, n in sorted(queue):
        taken[d] = taken.get(d, 0) + min(n, budget)
        budget -= min(n, budget)
    return sorted((d, n) for d, n in taken.items() if n)


def test_last_stages_against_plain_loops(spark, small, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(12)) for _ in range(3)]
    rows = []
    for i in range(40):
        text = [word() for _ in range(rng.randint(20, 90))]
        if i % 9 == 0:
            leak = list(items[i % 3])
            leak[5] = "#"
            text[7:7] = "".join(leak).split(" ")
        rows.append((i, " ".join(text), f"s{i % 4}"))
    rows += [(100 + i, rows[i][1] + " more", rows[i][2]) for i in (1, 2, 5)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[1:]:
        docs = saved(stage(spark, docs, str(tmp_path)), f"plain-{name}")
    assert sorted((r.doc_id, r.taken) for r in docs.collect()) == by_hand(rows, items)
