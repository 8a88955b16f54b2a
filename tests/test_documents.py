"""Grounded pages, transcripts and quotes."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import documents as op


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def found(spark, raw):
    return [(r.label, r.box, r.content) for r in one(spark, op.grounded(F.col("raw")), raw=raw)]


@pytest.mark.parametrize(("raw", "regions"), [
    ("", []), ("just prose", [("text", None, "just prose")]),
    ("<|det|>title [10, 20, 30, 40]<|/det|> A title\n<|det|>text [1, 2, 3, 4]<|/det|>Body", [("title", [10, 20, 30, 40], "A title"), ("text", [1, 2, 3, 4], "Body")]),
    ("<|ref|>Sub title<|/ref|>\n<|det|>[[1, -2, 3, 4]]<|/det|>head <|end|>", [("sub_title", [1, -2, 3, 4], "head")]),
    ("<|ref|>figure<|/ref|><|det|>[[1,2,3,4]]<|/det|><|det|>[5, 6, 7]<|/det|>x", [("image", [1, 2, 3, 4], ""), ("text", None, "x")]),
    ("<|ref|>No label<|/ref|><|det|>[[1,2,3,4]]<|/det|>after", [("text", [1, 2, 3, 4], "No label"), ("text", None, "after")]),
    ("before<|ref|>cut off", [("text", None, "before"), ("text", None, "cut off")]),
    ("<|det|>text [1,2,3,4]<|/det|>a<|det|>text [1,2", [("text", [1, 2, 3, 4], "a"), ("text", None, "text [1,2")]),
    ("<|det|>page number [1,2,3,4]<|/det|>7<｜end▁of▁sentence｜>", [("page_number", [1, 2, 3, 4], "7")]),
    ("<|ref|>open <|ref|>title<|/ref|><|det|>[[1,2,3,4]]<|/det|>x", [("text", [1, 2, 3, 4], "open title"), ("text", None, "x")]),
    ("<|ref|><|ref|><|det|><|det|>", []), ("a\x01b<|det|><|/det|>c", [("text", None, "ab"), ("text", None, "c")]),
])
def test_regions(spark, raw, regions):
    assert found(spark, raw) == regions


def test_regions_of_noise_lose_no_text_and_end(spark):
    near = random.Random(3)
    pieces = ["<|ref|>", "<|/ref|>", "<|det|>", "<|/det|>", "title", "[1, 2, 3, 4]", "[[1,2,3,4]]", " ", "text ", "word", "\n"]
    for raw in ("".join(near.choice(pieces) for _ in range(60)) + "last" for _ in range(25)):
        assert found(spark, raw)[-1][2].endswith("last")


def test_transcripts(spark):
    raw = "<|det|>header [0,0,9,9]<|/det|>Gone<|det|>title [0,0,9,9]<|/det|>One<|det|>image [0,0,9,9]<|/det|><|det|>image [0,0,9,9]<|/det|>Said<|det|>page_number [0,0,9,9]<|/det|>3<|det|>table [0,0,9,9]<|/det|><table></table>"
    assert one(spark, op.rendered(op.grounded(F.col("raw"))), raw=raw) == "## One\n\n[figure 1]\n\n[figure 2]\n\nSaid\n\n<table></table>"
    captions = F.create_map(F.lit(2), F.lit("a boat"))
    assert "[figure 1]\n\n[figure 2: a boat]" in one(spark, op.rendered(op.grounded(F.col("raw")), captions=captions), raw=raw)


REGIONS = "array<struct<label: string, box: array<int>, content: string>>"
BOX = [1, 2, 3, 4]


def quoted(spark, quote, regions, mode, text=None):
    rows = spark.createDataFrame([(quote, text if text is not None else " ".join(r[2] for r in regions), regions)], f"quote string, page string, found {REGIONS}")
    if mode == "text":
        return op.quoted_regions(rows, F.col("quote"), F.col("page"), F.col("found")).first().regions
    return rows.select({"row": op.quoted_rows, "figure": op.quoted_figures}[mode](F.col("quote"), F.col("found")).alias("x")).first().x


def test_quotes_across_blocks(spark):
    blocks = [("title", BOX, "An optional\n service."), ("text", BOX, ""), ("text", BOX, "Other   things, other ends."), ("text", None, "Nowhere.")]
    ask = lambda q, **k: quoted(spark, q, blocks, "text", **k)
    assert ask("service. Other") == [0, 2] and ask("optional service") == [0] and ask("  An\toptional ") == [0]
    assert ask("ends. Nowhere") == [] and ask("Invented.") == [] and ask(" ") == [] and ask("her") == []
    assert ask("service", text="An optional service. And another service.") == []


TABLE = "<table><tr><td>Operating costs</td><td>$40 (4%)</td></tr>\n<tr><td><b>Net</b> Income</td><td>$100 (10%)</td></tr></table>"


def test_quoted_rows(spark):
    ask = lambda q, *tables: quoted(spark, q, [("text", BOX, "Net Income | $100 (10%)"), *(("table", BOX, t) for t in tables)], "row")
    assert ask("Net  Income | $100 (10%)", TABLE) == [1]
    for bad in ("Net Income | $101 (10%)", "Net Income", "$100 (10%) | Net Income", "$40 (4%) | Net Income | $100 (10%)", ""):
        assert ask(bad, TABLE) == [], bad
    good = "Net Income | $100 (10%)"
    assert ask(good) == [] and ask(good, TABLE, TABLE) == [] and ask(good, f"<table><tr><td>{TABLE}</td></tr></table>") == [] and ask(good, TABLE.replace("</td>", "", 1)) == []
    assert quoted(spark, good, [("table", None, TABLE)], "row") == []
    for actual, said, same in (("\\(100 (10%)", "$100 (10%)", True), ("\\(100 (10%)", "$101 (10%)", False), ("\\(100 (10%)", "$-100 (10%)", False), ("200 (20%)\\)", "$200 (20%)", True), ("200", "$200", False)):
        assert bool(ask(f"Net | {said}", f"<table><tr><td>Net</td><td>{actual}</td></tr></table>")) == same, (actual, said)


def test_quoted_figures(spark):
    blocks = [("image", BOX, ""), ("text", BOX, "words"), ("image", BOX, "said"), ("image", None, "")]
    ask = lambda q: quoted(spark, q, blocks, "figure")
    assert ask("see [figure 2] and [figure 1]") == [0, 2] and ask("[figure 3]") == [] and ask("[figure 4]") == [] and ask("[figure 02] [figure 1]") == [] and ask("figure 1") == []


@pytest.mark.parametrize("size", [2_000_000, 12])
def test_quotes_of_any_length(spark, size, monkeypatch):
    monkeypatch.setattr(op, "PASS", size)
    texts = [(1, "The quick  brown fox.\nA world, a world"), (2, "underworld brown\tfox"), (3, None), (4, ""), (5, "aaaa")]
    quotes = [(1, "world"), (2, "brown fox"), (3, "quick brown fox. A"), (4, ""), (5, "absent"), (6, "aa"), (7, "world")]
    rows = op.locate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")).collect()
    flat = {i: " ".join((t or "").split()) for i, t in texts}
    clean = {i: " ".join(q.split()) for i, q in quotes}
    expected = {(i, d, t.find(q), t.count(q)) for i, q in clean.items() for d, t in flat.items() if q and q in t}
    assert {(r.item_id, r.doc_id, r.begin_at, r.times) for r in rows} == expected
    assert {r.item_id for r in rows if r.is_unique} == {3}
