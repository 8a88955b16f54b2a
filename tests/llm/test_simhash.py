import random
import re

import numpy as np
import xxhash

from recollect.llm import simhash


def brute(fps):
    """Component of each fingerprint by comparing all pairs."""
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    fps = sorted(up)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {f: root(f) for f in fps}


def plain_fingerprint(text):
    """A SimHash bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t", "One", "one two", "One two THREE", "ÉCOLE École école ü", "a b c a b c a b c", "x " * 500, "the cat\u00a0sat on\x0bthe mat again and again " * 40]


def test_fingerprints_bit_by_bit():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    texts = list(TEXTS)
    for _ in range(8):
        base = [rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(400)]
        for _ in range(4):
            texts.append(" ".join(base))
            base = list(base)
            base[rng.randrange(400)] = "new"
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    up = dict.fromkeys(fps)
    for i in fps:
        up[i] = i
    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                low, high = sorted((up[i], up[j]))
                up = {k: low if v == high else v for k, v in up.items()}
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows} == {(i, fps[i], up[i]) for i in fps}


def test_links_and_components_against_all_pairs(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(centre)
            for _ in range(rng.randint(1, 4)):
                centre ^= 1 << rng.randrange(64)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for chunk in (1024, 3):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, chunk)).collect()}
        got, want = {}, {}
        for f, r in brute(signed).items():
            want.setdefault(r, set()).add(f)
            got.setdefault(found.get(f, f), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_hard_cases(spark, hard, nothing):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[2] == by[1] and next(iter(by[1]))[1] == 1
    assert by[3] == by[4] == by[5] == {(0, 3)}
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.first_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 1), (True, 3), (True, 6), (True, 7), (True, 9)]


def jaccard(a, b):
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_first_of_each_against_all_pairs_of_jaccard(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(150)]
        for _ in range(6):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(1, 5)):
                base[rng.randrange(150)] = "x" + str(rng.randrange(10**6))
    up = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_each(df).collect()) == sorted(set(up))
    # Rows without an id, or of one id, are told apart by their texts.
    for id_ in (None, 7):
        df = spark.createDataFrame([(id_, texts[0]), (id_, texts[0]), (id_, texts[6]), (id_, texts[12])], "doc_id long, text string")
        assert sorted(r.text for r in simhash.first_of_each(df).collect()) == sorted([texts[0], texts[6], texts[12]])
