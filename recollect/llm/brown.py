"""Scores of texts by a class-based bigram model, its classes found by exchange clustering.

A word's probability is that of its class after the class before, times that of the word in its
class. Classes are found by exchange: each word goes to the class that raises the likelihood of
the corpus most, round after round, all words at once against the counts of the round before.

Documents are kept in chunks: a chunk lists its different words once, and its texts as places in
that list. What a round shuffles are, for each clustered word of a chunk, the counts of the classes
before and after it, and back to the chunk the class that the word goes to; a chunk's words that go
to one task are packed in a row. Chunks themselves stay in their buckets, each beside its own words'
classes: no task has those of the whole corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import bucketed, for_python

#: Characters of text, and documents, of a chunk: what a task holds at once, besides the longest text.
CHARS, DOCUMENTS = 12_000_000, 50_000
#: Classes of their own: the end of a text, words met once (as unknown words are), and words met up
#: to 3, 7, 15, ... times but too seldom to be clustered; then those that are found.
END, ONCE, RARE, FIRST = 0, 1, 2, 18
#: The share of the class model in a probability; the rest is the base's.
SHARE = 0.98
#: Counts of a class next to a word up to which gains come from tables.
TABLES = 8
#: Words, and words of chunks, that a task finds classes for, about.
WORDS, WORDS_OF_CHUNKS = 25_000, 500_000
CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, places binary, words array<string>, counts array<int>"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; of bytes, only A-Z have a lower case and only 20, 09-0D are blanks."""
    return text.encode().lower().split() if text else []


class Places(dict):
    """Word to place, a new one for each new word; place 0 is a text's end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1
        return place


def chunked(docs: DataFrame) -> DataFrame:
    """A row for each chunk of documents: what CHUNK says; place 0 is a text's end, others are one more than a word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            flat = np.concatenate(places)
            learned = flat[~np.repeat(np.array(held, bool), [len(p) for p in places])]
            counts = np.bincount(learned, minlength=len(words) + 1)[1:]
            values = [number, ids, held, [len(p) for p in places], zlib.compress(flat.tobytes(), 1), list(words), counts.tolist()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "doc_ids", "held", "sizes", "places", "words", "counts"])

        ids, held, places, words, chars = [], [], [], Places(), 0
        for b in batches:
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                found = tokens(text)
                own = np.zeros(len(found) + 1, np.int32)
                own[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                places.append(own)
                ids.append(doc_id)
                held.append(out)
                chars += len(text or "")
                if chars > CHARS or len(ids) >= DOCUMENTS:
                    yield row()
                    ids, held, places, words, chars, number = [], [], [], Places(), 0, number + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNK)


def hashed(wid: np.ndarray, k: int) -> np.ndarray:
    """The classes of clustered words before the first round."""
    return FIRST + wid % (k - FIRST)


class Classes:
    """The classes of clustered words: by hash at first, then as a round left them, a row for each chunk."""

    def __init__(self, k: int, table: DataFrame | None = None):
        self.k, self.table, self.words, self.looked = k, table, None, None

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Classes of words told by their ids, for a look at a model: its words come to the driver. Scores don't need it."""
        if self.table is None:
            return hashed(ids, self.k)
        if self.looked is None:
            found = self.words.distinct().orderBy("wid").toArrow()
            self.looked = found["wid"].to_numpy(), found["cls"].to_numpy()
        return self.looked[1][np.searchsorted(self.looked[0], ids)]


class Words:
    """A chunk's words: n, how often each was met in training, and their classes, ``found`` those of the clustered ones."""

    def __init__(self, texts: dict, n: np.ndarray, wid: np.ndarray, found: np.ndarray, least: int, ends: int):
        self.sizes = np.array(texts["sizes"], np.int64)
        self.places = np.frombuffer(zlib.decompress(texts["places"]), np.int32)
        self.n = np.zeros(texts["n_words"] + 1, np.int64)
        self.n[: len(n)] = n
        self.own, self.wid = np.flatnonzero(n >= least), wid
        self.n[0] = ends
        self.cls = np.where(self.n <= 1, ONCE, np.minimum(RARE - 1 + np.log2(np.maximum(self.n, 1)).astype(np.int64), FIRST - 1)).astype(np.uint8)
        self.cls[self.own] = found
        self.cls[0] = END
        self.token = self.cls[self.places]
        end = np.array([END], np.uint8)
        self.before = np.concatenate([end, self.token[:-1]])
        self.after = np.concatenate([self.token[1:], end])


def _numbers(column: pa.Array) -> np.ndarray:
    """The one list of a column of one row, as an array."""
    return column.flatten().to_numpy(zero_copy_only=False)


def over(model: dict, f: Callable[[Words, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` of each chunk, with its words' counts and classes; all tables are in the same buckets."""
    chunks, known, classes, least, ends, k = model["chunks"], model["packed"], model["classes"].table, model["least"], model["ends"], model["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                col = lambda c, row=row: row.column(row.schema.get_field_index(c))
                texts = {"sizes": _numbers(col("sizes")), "places": col("places")[0].as_py(), "n_words": col("n_words")[0].as_py()}
                n, wid = _counted(col("n")[0].as_py()), np.frombuffer(col("wid")[0].as_py() or b"", np.int64)
                cls = col("cls")[0].as_py()
                words = Words(texts, n, wid, hashed(wid, k) if cls is None else np.frombuffer(cls, np.uint8), least, ends)
                words.learned = ~np.repeat(_numbers(col("held")).astype(bool), words.sizes)
                yield from f(words, row)

    rows = chunks.select("chunk", "doc_ids", "held", "sizes", "places", "n_words").join(known.select("chunk", "n", "wid"), "chunk", "left")
    rows = rows.withColumn("cls", F.lit(None).cast("binary")) if classes is None else rows.join(classes, "chunk", "left")
    return rows.mapInArrow(run, schema)


def packed(found: DataFrame, least: int) -> DataFrame:
    """Of each chunk in ``found`` (chunk, the list of at, n, wid, first of its words) how often all words were met in training, by place, and the ids of the clustered ones.

    Also how many words it is the first chunk to have, how many of these were met once and twice,
    and how many it has clustered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, n, wid, first = (x.to_numpy(zero_copy_only=False) for x in b.column(1).slice(i, 1).flatten().flatten())
                counts = [first.sum(), (n[first] == 1).sum(), (n[first] == 2).sum(), (n >= least).sum()]
                by_place, ids = np.zeros(at.max() + 1, np.int64), np.zeros(at.max() + 1, np.int64)
                by_place[at], ids[at] = n, wid
                arrays = [zlib.compress(by_place.tobytes(), 1), ids[by_place >= least].tobytes()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x], pa.binary()) for x in arrays), *(pa.array([int(x)], pa.int64()) for x in counts)], names=["chunk", "n", "wid", "words", "once", "twice", "clustered"])

    return found.mapInArrow(run, "chunk long, n binary, wid binary, words long, once long, twice long, clustered long")


def _counted(n: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(n), np.int64) if n else np.empty(0, np.int64)


def unpacked(packed: DataFrame, least: int) -> DataFrame:
    """chunk, own, wid: the places and ids of each chunk's clustered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([np.flatnonzero(_counted(x) >= least) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))
            wid = pa.array([np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), own, wid], names=["chunk", "own", "wid"])

    return packed.select("chunk", "n", "wid").mapInArrow(run, "chunk long, own array<long>, wid array<long>")


def _pairs(rows: np.ndarray, ctx: np.ndarray, n_rows: int, k: int) -> pa.Array:
    """For each row the classes it is met with: bytes of class and count in turn, a count over 255 in parts."""
    code, count = np.unique(rows.astype(np.int32 if n_rows * k < 1 << 31 else np.int64) * k + ctx, return_counts=True)
    times = (count + 254) // 255
    last = np.cumsum(times) - 1
    part = np.full(times.sum(), 255, np.int64)
    part[last] = count - (times - 1) * 255
    data = np.empty((len(part), 2), np.uint8)
    data[:, 0], data[:, 1] = np.repeat(code % k, times), part
    ends = np.cumsum(np.bincount(np.repeat(code // k, times), minlength=n_rows)) * 2
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each binary value of a column ends, from 0, and all their bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value of each stretch of ``values`` between two of ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpaired(column: pa.Array, word: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Words x classes: what ``_pairs`` of all rows of each word add up to."""
    ends, data = _bytes(column)
    return _added(word, np.diff(ends), data, n_words, k)


def _added(word: np.ndarray, sizes: np.ndarray, data: np.ndarray, n_words: int, k: int) -> np.ndarray:
    of = np.repeat(word, sizes // 2)
    return np.bincount(of * k + data[::2], weights=data[1::2], minlength=n_words * k).reshape(n_words, k)


def log_mass(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0: likelihoods are sums of these over counts."""
    return x * np.log(np.maximum(x, 1e-300))


class Exchange:
    """The gain of each class for words, from the class bigrams ``m`` of the round before."""

    def __init__(self, m: np.ndarray):
        self.k, self.both = len(m), []
        for side in (m, np.ascontiguousarray(m.T)):
            logs = log_mass(side)
            self.both.append((side, np.array([log_mass(side + p) - logs for p in range(TABLES + 1)]), side.sum(0)))

    def best(self, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class of greatest likelihood for each word, all other words as they are; its own is judged without it.

        ``before`` and ``after`` are how often each word is met after and before each class.
        """
        gain = np.zeros((len(own), self.k))
        n = before.sum(1)
        for (m, tables, total), seen in zip(self.both, (before, after), strict=True):
            w, c = np.nonzero(seen)
            p = seen[w, c].astype(np.int64)
            bounds = np.r_[0, np.flatnonzero(w[1:] != w[:-1])[49::50] + 1, len(w)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):  # 50 words, which stay in cache
                if i == j:
                    continue
                at, ctx, x = w[i:j], c[i:j], p[i:j]
                each = tables[np.minimum(x, TABLES), ctx]
                many = np.flatnonzero(x > TABLES)
                each[many] = log_mass(m[ctx[many]] + x[many, None]) - log_mass(m[ctx[many]])
                held = m[ctx, own[at]]
                each[np.arange(len(at)), own[at]] = log_mass(held) - log_mass(np.maximum(held - x, 0))
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                gain[at[first]] += np.add.reduceat(each, first, axis=0)
            times, at = np.unique(n, return_inverse=True)
            gain -= (log_mass(total + times[:, None]) - log_mass(total))[at]
            held = total[own]
            row = np.arange(len(own))
            gain[row, own] += log_mass(held + n) - 2 * log_mass(held) + log_mass(np.maximum(held - n, 0))
        gain[:, :FIRST] = -np.inf
        return np.where(n > 0, gain.argmax(1), own)


def exchanged(stats: DataFrame, m: np.ndarray, tasks: int) -> DataFrame:
    """chunk, cls: the new classes of each chunk's clustered words, a byte each, in the order that the chunk has them.

    All rows that have a word meet in the task that their ``task`` names.
    """
    k = len(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        model, read = Exchange(m), lambda c, kind: np.concatenate([_bytes(b.column(c))[1] for b in rows]).view(kind)
        wid, first, word = np.unique(read(2, np.int64), return_index=True, return_inverse=True)
        own = read(4, np.uint8)[first].astype(np.int64)
        before, after = (_added(word, read(c, np.int32), read(c + 1, np.uint8), len(wid), k) for c in (5, 7))
        cls = np.concatenate([model.best(before[i : i + 10_000], after[i : i + 10_000], own[i : i + 10_000]) for i in range(0, len(wid), 10_000)]).astype(np.uint8)[word]
        at = 0
        for b in rows:
            ends = _bytes(b.column(4))[0]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), _cut(cls[at : at + ends[-1]], ends)], names=["chunk", "slots", "cls"])
            at += ends[-1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, pieces in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                slot, found = (np.concatenate([np.frombuffer(p[c], kind) for p in pieces]) for c, kind in (("slots", np.int32), ("cls", np.uint8)))
                cls = np.empty(len(slot), np.uint8)
                cls[slot] = found
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([cls.tobytes()], pa.binary())], names=["chunk", "cls"])

    moved = stats.repartitionById(tasks, F.col("task")).mapInArrow(run, "chunk long, slots binary, cls binary")
    return moved.groupBy("chunk").agg(F.collect_list(F.struct("slots", "cls")).alias("pieces")).mapInArrow(placed, "chunk long, cls binary")


def fit(docs: DataFrame, classes: int = 64, rounds: int = 3, least: int = 2, share: float = 0.0) -> dict:
    """The model's tables and numbers, from the rows of ``docs`` that aren't held out; see ``score``.

    A clustered word is told by 64 bits of hash: two that share them would share a class.
    """
    spark = docs.sparkSession
    for_python(spark)
    parts, k = int(spark.conf.get("spark.sql.shuffle.partitions")), classes + FIRST
    if k > 256:
        raise ValueError("a class is a byte, so 238 are found at most")
    chunks = bucketed(chunked(docs).withColumn("n_words", F.size("words")), "brown-chunks", "chunk", parts)
    added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x)
    ends, total = chunks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)), F.coalesce(F.sum(added(F.transform("counts", lambda x: x.cast("long")))), F.lit(0))).first()
    least = max(1, least, math.ceil(share * (total + ends)))
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", (F.col("at") + 1).alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    everywhere = Window.partitionBy("word")  # a row a chunk that has the word
    met = listed.withColumn("n", F.sum("c").over(everywhere)).withColumn("first", F.min("chunk").over(everywhere) == F.col("chunk")).filter("n > 0")
    word = F.struct("at", "n", F.shiftrightunsigned(F.xxhash64("word"), 1).alias("wid"), "first")
    found = met.select("chunk", word.alias("f")).groupBy("chunk").agg(F.collect_list("f").alias("f"))  # a chunk's own words
    found = bucketed(found, "brown-found", "chunk", parts)  # written first: lists are built with no Python beside them
    known = bucketed(packed(found, least), "brown-known", "chunk", parts)
    words, once, twice, clustered = known.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "once", "twice", "clustered"))).first()
    tasks = max(parts, -(-words // WORDS), -(-clustered // WORDS_OF_CHUNKS))
    model = {"chunks": chunks, "packed": known, "known": unpacked(known, least), "least": least, "ends": ends, "words": words, "tokens": total + ends, "once": once, "twice": twice, "k": k, "classes": Classes(k), "likelihood": []}
    m = bigrams(model)
    model["likelihood"].append(likelihood(m))
    for _ in range(rounds):
        now = Classes(k, bucketed(exchanged(contexts(model, tasks), m, tasks), "brown-classes", "chunk", parts))
        after = bigrams(model | {"classes": now})
        if likelihood(after) <= model["likelihood"][-1]:  # words moved at once can be worse off together
            break
        m, model["classes"] = after, now
        model["likelihood"].append(likelihood(m))
    model["classes"].words = over(model, _told, "wid long, cls int")
    return model | {"m": m}


def _told(words: Words, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """wid, cls of a chunk's clustered words."""
    yield pa.RecordBatch.from_arrays([pa.array(words.wid, pa.int64()), pa.array(words.cls[words.own], pa.int32())], names=["wid", "cls"])


def likelihood(m: np.ndarray) -> float:
    """What classes contribute to the log-likelihood of a corpus with these class bigrams."""
    return float(log_mass(m).sum() - log_mass(m.sum(0)).sum() - log_mass(m.sum(1)).sum())


def bigrams(model: dict) -> np.ndarray:
    """How often each class follows each, over all training texts: classes x classes numbers reach the driver."""
    k = model["k"]

    def run(words: Words, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.bincount(words.before[words.learned].astype(np.int32) * k + words.token[words.learned], minlength=k * k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"code": pa.array(held, pa.int64()), "n": pa.array(n[held], pa.int64())})

    out = np.zeros(k * k)
    for r in over(model, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(k, k)


def contexts(model: dict, tasks: int) -> DataFrame:
    """Each chunk's clustered words and their training contexts, a row for all words that go to one of ``tasks`` tasks.

    task, chunk, then packed: wids, slots (their places among the chunk's clustered words), cls,
    and of both sides the sizes of the words' ``_pairs`` and these.
    """
    k = model["k"]
    schema = "task int, chunk long, wids binary, slots binary, cls binary, n_before binary, before binary, n_after binary, after binary"

    def run(words: Words, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        task = (words.wid % tasks).astype(np.int32)
        order = np.argsort(task, kind="stable")
        place = np.full(len(words.n), -1, np.int32)
        place[words.own[order]] = np.arange(len(order), dtype=np.int32)
        at = place[words.places]
        seen = words.learned & (at >= 0)
        found, n = np.unique(task, return_counts=True)
        ends, sides = np.r_[0, np.cumsum(n)], []
        for c in (words.before, words.after):
            stops, data = _bytes(_pairs(at[seen], c[seen], len(order), k))
            sides += [_cut(np.diff(stops), ends), _cut(data, stops[ends])]
        chunk = pa.array(np.full(len(found), row.column(row.schema.get_field_index("chunk"))[0].as_py()), pa.int64())
        own = [_cut(x, ends) for x in (words.wid[order], order.astype(np.int32), words.cls[words.own[order]].astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), chunk, *own, *sides], names=schema.replace(",", "").split()[::2])

    return over(model, run, schema)


def probabilities(m: np.ndarray, once: int, twice: int) -> tuple[np.ndarray, float]:
    """Class after class, smoothed, and the part of the class ONCE that words met once keep.

    Words met once stand for unknown ones as well (each would be unknown without its one text),
    so an unknown word gets their mass; they themselves get what words met twice tell that such
    words recur with.
    """
    keep = min(1.0, max(0.1, 2 * twice / once)) if once else 0.1
    t = m.copy()
    t[:, ONCE] *= 1 + keep
    even = t.sum(0) / max(t.sum(), 1.0)
    return (t + len(m) * even) / (t.sum(1, keepdims=True) + len(m)), keep


def score(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from those not held out.

    Tokens are the words of the lower-cased (A-Z) whole text, and one end. ``base_score`` adds
    log10((c + 1) / (N + V + 1)), c a token's count in training, N all, V the different ones.
    ``score`` is the model's log10 probability: SHARE of P(class | class before) P(word | class),
    the rest of the base's, so over all known tokens and one unknown it adds up to 1. ``classes``
    are clustered by exchange, ``rounds`` rounds at most and only while the likelihood rises,
    over the words met ``least`` times that are ``share`` of all tokens or more: all but those met
    once, unless told otherwise. Others are in classes by how often they were met; words met
    once are in one, as they stand for unknown words. Counts are of all training texts; what is
    gathered grows with them.

    Null and empty texts have the end alone; very long ones are read whole. A null doc_id isn't
    held out; repeated rows are texts of their own. Ties between classes go to the smaller
    number. An empty table gives no rows; other columns are ignored. Nothing learned from: both
    scores are those of a single unknown token.
    """
    model = fit(docs, **options)
    m, once, size, total = model["m"], model["once"], model["words"] + (model["ends"] > 0), model["tokens"]
    after, keep = probabilities(m, once, model["twice"])
    in_class = np.maximum(m.sum(0), 1.0)

    def run(words: Words, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = words.n.astype(np.float64)
        base = (n + 1) / (total + size + 1)
        emitted = np.where(words.cls == ONCE, np.where(n > 0, keep / ((1 + keep) * max(once, 1)), 1 / (1 + keep)), n / in_class[words.cls])
        share = SHARE if total else 0.0
        p = share * after[words.before, words.token] * emitted[words.places] + (1 - share) * base[words.places]
        starts = np.cumsum(words.sizes) - words.sizes
        col = lambda c: row.column(row.schema.get_field_index(c)).flatten()
        known = np.add.reduceat((words.n > 0)[words.places].astype(np.int64), starts)
        sums = [np.add.reduceat(np.log10(x), starts) for x in (base[words.places], p)]
        yield pa.RecordBatch.from_arrays([col("doc_ids"), col("held"), pa.array(words.sizes), pa.array(known), pa.array(np.full(len(known), total), pa.int64()), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return over(model, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
