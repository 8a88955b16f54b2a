import hashlib
import random
from collections import Counter

import numpy as np

from recollect.llm import substrings


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        kept = bytes(c for c, gone in zip(d, cover, strict=True) if not gone)
        out.append((len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts):
    rows = substrings.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_all_strings(spark):
    rng = random.Random(3)
    words = ["ab", "cde", "fé", "ghij", "k", "😀lm"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    common = [prose(80) for _ in range(4)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 900, "z" * 200, "z" * 200, "ab" * 400]
    for _ in range(50):
        parts = [prose(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            c = rng.choice(common)
            a = rng.randrange(len(c) // 2)
            piece = c[a : a + rng.randrange(150, 600)]
            if rng.random() < 0.5 and len(piece) > 20:
                i = rng.randrange(len(piece))
                piece = piece[:i] + "#" + piece[i + 1 :]
            parts += [piece, prose(rng.randrange(30))]
        texts.append("".join(parts))
    texts += [texts[20], texts[21]]
    assert got(spark, texts) == brute(texts)


def test_parts_change_nothing(spark, monkeypatch):
    base = " ".join(str(i * i % 977) for i in range(900))
    texts = [base[i:] + "!" * (i % 3) + base[: 300 + i] for i in range(0, 60, 3)]
    want = brute(texts)
    monkeypatch.setattr(substrings, "PART", 3)
    assert got(spark, texts) == want


def test_runs_of_long_texts_cover_all_strings(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    text = (" ".join(str(i) for i in range(1500))).encode()
    r = substrings.runs([text, b"short", text[:450]])
    for row, t in ((0, text), (2, text[:450])):
        at = sorted(x for s, n, k in zip(r["start"], r["size"], r["row"], strict=True) if k == row for x in range(s, s + n))
        assert at == list(range(len(t) - 199))


def test_hard_cases(hard, nothing):
    rows = substrings.deduplicate(hard).collect()
    assert len(rows) == hard.count()
    assert {r.doc_id: r.n_removed for r in rows}[3] == 0
    assert {r.doc_id: r.n_spans for r in rows}[6] == 1
    assert substrings.deduplicate(nothing).collect() == []


def test_repeated_rows_are_repeated_text(spark):
    text = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other " + text[:50])], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.deduplicate(df).collect()) == [0, len(text), len(text)]


def test_rows_without_ids_and_copies(spark):
    base = " ".join(str(i * i % 977) for i in range(90))
    texts = [f"{i} {base[i % 40 :]} {i * 31 % 1009}" for i in range(600)] + [f"{base} one row many times"] * 400
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = substrings.deduplicate(df).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(brute(texts))


def test_refinement_against_bytes():
    rng = random.Random(7)
    for length in (8, 20, 64, 200):
        data = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(length, 3 * length))) for _ in range(6)]
        data.append(data[0][2 : 2 + length + 5])
        sizes = np.array([len(d) for d in data])
        ids = substrings.refine(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes - length + 1, length).tolist()
        strings = [d[i : i + length] for d in data for i in range(len(d) - length + 1)]
        assert len(set(zip(strings, ids, strict=True))) == len(set(strings)) == len(set(ids))
