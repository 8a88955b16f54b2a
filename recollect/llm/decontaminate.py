"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: a passage within k
edits of it holds one piece unchanged. All pieces are found at once by an Aho-Corasick
automaton, and what surrounds a hit is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import for_python, small

#: Edits allowed, as a share of an item's characters.
RATE = 0.08
#: Characters of items that one pass over the documents looks for: what a broadcast holds.
BLOCK = 2_000_000


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def bordered(text: str, begin: int, end: int) -> bool:
    """Whether no word of ``text`` goes on across either end of text[begin:end]."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not (inside(begin) or inside(end))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (every & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = (ph << 1) & every
        mh = (mh << 1) & every
        pv = mh | (every & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float = RATE):
        self.items = []
        for item_id, text in items:
            if t := normal(text):
                self.items.append((item_id, t, int(rate * len(t))))
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                held.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def matches(self, text: str | None, first: bool = False) -> list[tuple[int, int]]:
        """(item_id, distance) of each item within its budget of some part of the text; ``first``: of one."""
        t = normal(text)
        if not t or self.empty:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, begins in sorted(starts.items()):
            item_id, item, k = self.items[n]
            best = self._distance(t, item, k, sorted(begins)) if k else int(not any(bordered(t, at, at + len(item)) for at in begins))
            if best <= k:
                out.append((item_id, best))
                if first:
                    break
        return out

    @staticmethod
    def _distance(text: str, item: str, k: int, begins: list[int]) -> int:
        if item in text:
            return 0
        best, i = k + 1, 0
        while i < len(begins) and best:
            low = high = begins[i]
            while i < len(begins) and begins[i] - high <= 2 * k:  # windows that overlap are read once
                high = begins[i]
                i += 1
            window = text[max(0, low - k) : high + len(item) + k]
            if len(window) >= len(item) - k:
                best = min(best, myers(item, window)[0])
        return best


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` characters, or of one longer item."""
    held, size = [], 0
    for r in benchmark.filter("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r.text) > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance of each document and item that it holds within the error budget.

    Case and white space are set aside; a budget is ``rate`` x the item's characters. The
    least distance over the text's parts is given. All items are looked for in all documents,
    a block of items at a time, so what is broadcast is bounded by ``block``. An item too short
    for any error must stand between word borders. Null and blank texts and items match
    nothing; whole texts are read, however long. Repeated rows give repeated results. Other columns are
    ignored; an empty table gives an empty result. No shuffle.
    """
    spark = docs.sparkSession
    for_python(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int")
    for n, items in enumerate(blocks(benchmark, block)):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for b in small(batches):
                rows = [(d, i, x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, x in matcher.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        found = source.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = found if n == 0 else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item within its error budget. No shuffle.

    As ``leaks`` on nulls, repeats, short items and long texts; all columns stay as they are.
    """
    spark = docs.sparkSession
    for_python(spark)
    at = docs.columns.index("text")
    for items in blocks(benchmark, block):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for b in small(batches):
                yield b.filter(pa.array([not matcher.matches(t.as_py(), first=True) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
