"""Language identification by segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, found by the forward algorithm,
and a text's is the product over its words. Only the piece probabilities are learned, by
expectation-maximisation with the forward-backward algorithm over the same segmentations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import for_python, fresh, least_by_hash, saved, small

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Probability of a character that is no piece of the vocabulary.
UNKNOWN = 1e-7
#: Letters up to which words are scored side by side; longer ones are scored one by one, and
#: learned from in parts.
SHORT_WORD = 40
#: Words a task keeps scores of.
CACHE = 400_000
UNDETERMINED = "und"
#: Chosen texts' hashes up to which they are broadcast to the documents; beyond, both are shuffled.
BROADCAST_TEXTS = 200_000


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Piece to number, of the pieces made of letters, with or without a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = sorted({p.lower() for p in pieces if LETTERS.fullmatch(p.removeprefix(START)) or p == START})
    return {p: i for i, p in enumerate(kept)}


def words(text: str | None) -> list[str]:
    """A text's words: runs of letters, lower-cased, with the start mark. Other numerals are no letters."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return [START + w for w in found]


def parts(word: str) -> list[str]:
    """A marked word in parts of at most SHORT_WORD letters, each marked."""
    if len(word) <= SHORT_WORD + 1:
        return [word]
    return [START + word[i : i + SHORT_WORD] for i in range(1, len(word), SHORT_WORD)]


def lattice(pieces: dict[str, tuple[float, ...]], n: int) -> tuple[dict[str, int], np.ndarray]:
    """Pieces to rows of their probabilities in ``n`` languages, and all other ends of pieces to -1.

    Read backwards from a position, a string that is no piece's end ends the search. Row 0 is
    that of a character that is no piece.
    """
    table = {p[i:]: -1 for p in pieces for i in range(1, len(p))}
    table |= {c: 0 for p in pieces for c in p}
    table |= {p: i for i, p in enumerate(pieces, 1)}
    return table, np.array([(UNKNOWN,) * n, *pieces.values()])


def forward(found: list[str], table: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """[word, end, language]: the total probability of word[:end] over all its segmentations.

    Words side by side: the pieces that end at each place are looked up, then one place after
    the other is summed from the places before it.
    """
    longest = max(map(len, found), default=0)
    at = np.zeros((len(found), longest + 1, probs.shape[1]))
    at[:, 0] = 1.0
    ending: list[list[int]] = [[] for _ in range(longest + 1)]  # word, begin and piece in one number
    get = table.get
    for row, word in enumerate(found):
        row <<= 32
        for end in range(1, len(word) + 1):
            add = ending[end].append
            add(row | (end - 1) << 24 | get(word[end - 1], 0))
            for begin in range(end - 2, -1, -1):
                piece = get(word[begin:end])
                if piece is None:
                    break
                if piece > 0:
                    add(row | begin << 24 | piece)
    for end in range(1, longest + 1):
        x = np.array(ending[end], np.int64)
        rows = x >> 32
        part = at[rows, x >> 24 & 0xFF] * probs[x & 0xFFFFFF]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        at[rows[first], end] = np.add.reduceat(part, first)
    return at


def forward_long(word: str, table: dict[str, int], probs: np.ndarray, reach: int | None = None) -> np.ndarray:
    """[language]: log of the total probability of a word of any length over all its segmentations.

    Only the places that a piece can begin at are kept, scaled so that the last one is 1;
    ``reach`` is the longest piece's length.
    """
    reach = reach or max(map(len, table), default=1)
    at = np.zeros((reach, probs.shape[1]))  # a ring: place i is row i % reach
    at[0] = 1.0
    logs = np.zeros(probs.shape[1])
    for end in range(1, len(word) + 1):
        total = at[(end - 1) % reach] * probs[table.get(word[end - 1], 0)]
        for begin in range(end - 2, max(-1, end - reach - 1), -1):
            piece = table.get(word[begin:end])
            if piece is None:
                break
            if piece > 0:
                total = total + at[begin % reach] * probs[piece]
        logs += np.log(total)
        at /= total
        at[end % reach] = 1.0
    return logs


def expected(word: str, alpha: np.ndarray, table: dict[str, int], probs: np.ndarray) -> list[tuple[str, float]]:
    """Expected number of times each piece is used in a word, over all its segmentations, in one language.

    ``alpha`` is the word's part of ``forward``, ``probs`` the language's column.
    """
    size = len(word)
    before, beta = alpha.tolist(), [0.0] * size + [1.0]
    out = []
    for end in range(size, 0, -1):
        for begin in range(end - 1, -1, -1):
            piece = table.get(word[begin:end], 0 if begin == end - 1 else None)
            if piece is None:
                break
            if piece < 0:
                continue
            p = probs[piece]
            beta[begin] += p * beta[end]
            out.append((word[begin:end], before[begin] * p * beta[end] / before[size]))
    return out


def fit(docs: DataFrame, path: str = VOCABULARY, per_language: int = 2000, rounds: int = 2) -> dict:
    """Piece probabilities by language, from rows with a lang and text.

    Fits on at most ``per_language`` different texts of each language, those of least hash:
    the documented bound of the sample. Their words are counted by Spark,
    and each round adds up the expected uses of pieces by Spark. The result holds languages x
    vocabulary numbers at most. No labelled rows give no languages.
    """
    spark = docs.sparkSession
    for_python(spark)
    rows = docs.filter("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("key"), "text")
    chosen = saved(least_by_hash(rows.select("lang", "key").distinct(), "lang", per_language, ["key"], ["key"]), "language-chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_TEXTS else chosen
    texts = rows.join(few, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")
    known = vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, p) for w in words(text) for p in parts(w))
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counted = texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = saved(counted.repartition(32, "word"), "language-words")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    model = {lang: {p: 0.02 ** min(4, len(p)) for p in known} for lang in langs}
    for _ in range(rounds):
        now = model

        def uses(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            tables: dict = {}
            for b in small(batches):
                total: Counter = Counter()
                words_of: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words_of.setdefault(lang, {})[word] = n
                for lang, ns in words_of.items():
                    if lang not in tables:
                        tables[lang] = lattice({p: (x,) for p, x in now[lang].items()}, 1)
                    table, probs = tables[lang]
                    own = probs[:, 0].tolist()
                    for word, alpha in zip(ns, forward(list(ns), table, probs), strict=True):
                        for piece, x in expected(word, alpha[: len(word) + 1, 0], table, own):
                            total[lang, piece] += ns[word] * x
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "piece": [k[1] for k in total], "x": list(total.values())}, pa.schema([("lang", pa.string()), ("piece", pa.string()), ("x", pa.float64())]))

        found = counted.mapInArrow(uses, "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        got: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for r in found.collect():  # languages x vocabulary at most, and characters that are no piece
            if r.piece in known:
                got[r.lang][r.piece] = r.x
        model = {}
        for lang in langs:
            total = sum(got[lang].values()) + 0.01 * len(known)
            model[lang] = {p: (got[lang].get(p, 0.0) + 0.01) / total for p in known}
    return {"langs": langs, "pieces": {p: tuple(model[lang][p] for lang in langs) for p in known}}


class Scores:
    """Log probabilities of words in each language; forgets all when it holds CACHE words."""

    def __init__(self, model: dict):
        self.table, self.probs = lattice(model["pieces"], len(model["langs"]))
        self.reach = max(map(len, self.table), default=1)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.empty((0, self.probs.shape[1]))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The log probability of each text in each language."""
        wanted = set().union(*texts)
        if len(self.place) + len(wanted) > CACHE:
            self._reset()
        new = sorted(wanted - self.place.keys())
        found = [self.logs]
        short = [w for w in new if len(w) <= SHORT_WORD + 1]
        long = [w for w in new if len(w) > SHORT_WORD + 1]
        self.place.update(zip(short + long, range(len(self.place), len(self.place) + len(new)), strict=True))
        for i in range(0, len(short), 4096):
            some = short[i : i + 4096]
            at = forward(some, self.table, self.probs)
            found.append(np.log(np.maximum(at[np.arange(len(some)), [len(w) for w in some]], 1e-300)))
        found += [forward_long(w, self.table, self.probs, self.reach)[None, :] for w in long]
        self.logs = np.concatenate(found)
        get = self.place.__getitem__
        return [self.logs[np.fromiter(map(get, t), np.int64, len(t))].sum(0) for t in texts]


def verdict(logs: np.ndarray, n_words: int, langs: list[str]) -> tuple[str, float]:
    """The likeliest language, and its share of the likelihood were the text of 10 words at most.

    Ties go to the language that sorts first.
    """
    if not n_words or not langs:
        return UNDETERMINED, 0.0
    best = int(np.argmax(logs))
    return langs[best], float(1 / np.exp(np.maximum(-700.0, (logs - logs[best]) * min(1.0, 10 / n_words))).sum())


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (default: doc_id) of each row, with lang_pred and score, named by ``out``.

    Reads only the whole text, however long. lang_pred is ``und`` and score 0 if text is null or
    has no letters, or the model has no language. Kept columns with a name of ``out`` give way to
    it. No shuffle.
    """
    spark = docs.sparkSession
    for_python(spark)
    kept = docs.select(*(c for c in (["doc_id"] if keep is None else keep) if c.lower() not in out))
    shipped = spark.sparkContext.broadcast(model)  # vocabulary x languages
    names = [*kept.columns, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        scores = Scores(m)
        for b in small(batches):
            texts = [words(t.as_py()) for t in b.column(b.num_columns - 1)]
            logs = scores.of(texts) if m["langs"] else texts
            got = [verdict(x, len(t), m["langs"]) for x, t in zip(logs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    source = docs.select(*kept.columns, F.col(text).cast("string").alias(fresh(kept, "text")[0]))
    schema = T.StructType([*kept.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from those not held out.

    A null doc_id isn't held out. Rows with one text are learned from once a language. Null texts
    and those without letters are ``und``, with score 0, and aren't learned from; very long ones
    are read whole. Of equally likely languages the first by name is taken. Repeated rows give
    repeated results; an empty table an empty result; other columns are ignored.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), path)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
