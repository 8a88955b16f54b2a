"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

Byte offsets where tokens of both end cut a text into groups. A group of one token each, of the
bytes that an array from A's ids to B's holds ready (the identity map), is counted in a vector as
long as the vocabulary; only the pairs of other groups are shuffled.

Both tokenizers work alike on a stretch of text wherever it stands, if it is cut out before a
blank that follows something else. So each chunk of documents encodes its different stretches
once, and a text is a list of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm.common import for_python, saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text, and documents, of a chunk: what a task holds at once, besides the longest text.
CHARS, DOCUMENTS = 12_000_000, 20_000
#: Stretches that are encoded at once.
BATCH = 20_000
#: Fixed value: the pattern by which a byte-level tokenizer cuts text first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past which Unicode's newer versions may differ in what is a letter.
_UNSETTLED = re.compile("[^\x00-ɏ]")


class ByteBpe:
    """A byte-level tokenizer: ids of a text, and each id's bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # shown as themselves; other bytes as 256, 257, ...
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        byte = {c: b for b, c in shown.items()}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        pairs = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(p.split(" ") for p in pairs))
        ranks = {self.bytes[i]: i for i in range(256 + len(pairs))}
        # where ids follow the merges, this encoder gives the same ids, and faster
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order and len(ranks) == 256 + len(pairs) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or _UNSETTLED.search(t)]
        out = [[] if self.fast is None or _UNSETTLED.search(t) else self.fast.encode_ordinary(t) for t in texts]
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceBpe:
    """A tokenizer of pieces with byte fallback, over texts that begin with a space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        own = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        #: Blanks that are part of some piece: no text is cut before these.
        self.bound = sorted({c for p in own for c in p if c.isspace()})
        self.cuts = not any("▁" in p.lstrip("▁") for p in own)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of stretches of text; a space in front is the one that the model adds."""
        got = self.model.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if t == " ":
                got[i] = [self.space]
            elif t[:1] != " ":
                got[i] = got[i][1:] if got[i] and got[i][0] == self.space else [-1]
        return got


class Aligner:
    def __init__(self, a: str = BYTE_BPE, b: str = PIECE_BPE):
        self.a, self.b = ByteBpe(a), PieceBpe(b)
        self.width_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.width_b = np.array([len(x) for x in self.b.bytes] + [0], np.int64)  # at -1 what can't be encoded
        ids = {x: i for i, x in reversed(list(enumerate(self.b.bytes)))}
        #: A's id to the least of B's ids with the same bytes, or -1.
        self.identity = np.array([ids.get(x, -1) for x in self.a.bytes], np.int64)
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names = [(names(len(t.bytes), ","), names(len(t.bytes), end)) for t, end in ((self.a, "|"), (self.b, ";"))]
        bound = "".join(map(re.escape, self.b.bound))
        self.stretch = re.compile(rf"\s*\S+(?:[{bound}]\s*\S*)*|\s+" if bound else r"\s*\S+|\s+") if self.b.cuts else re.compile(r"(?s).+")

    def stretches(self, text: str) -> list[str]:
        """What a space and ``text`` are cut into, each encoded alike wherever it stands."""
        return self.stretch.findall(f" {text}")

    def code(self, a, b):
        return a * np.int64(len(self.b.bytes)) + b

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each stretch: whether both tokenizers give its bytes, n_a, n_b, n_groups, links, and its groups as text.

        Links are the spans between neighbouring ends of tokens of either: each lies in one
        token of A and one of B. They come as ``code``, with ``fast`` where the group is one
        that the identity map holds, and ``of``, the number of the stretch.
        """
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        whole = np.array([b"".join(map(self.b.bytes.__getitem__, y)) == t.encode() == b"".join(map(self.a.bytes.__getitem__, x)) if -1 not in y else False for t, x, y in zip(texts, ids_a, ids_b, strict=True)], bool)
        n_a = np.where(whole, np.array([len(x) for x in ids_a], np.int64), 0)
        n_b = np.where(whole, np.array([len(x) for x in ids_b], np.int64), 0)
        flat = lambda ids: np.array([i for x, w in zip(ids, whole, strict=True) if w for i in x], np.int64)
        a, b = flat(ids_a), flat(ids_b)
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        each = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        one = (each[0] == 1) & (each[1] == 1)
        every = np.union1d(end_a, end_b)
        link_a, link_b, group = a[np.searchsorted(end_a, every)], b[np.searchsorted(end_b, every)], np.searchsorted(both, every)
        stretch_a = np.repeat(np.arange(len(texts)), n_a)
        stretch = np.empty(len(both), np.int64)
        stretch[group_a] = stretch_a
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        words = np.empty(len(a) + len(b), object)
        before = np.concatenate([[0], np.cumsum(each[1])]), np.concatenate([[0], np.cumsum(each[0])])
        words[np.arange(len(a)) + before[0][group_a]] = np.where(last_a, self.names[0][1][a], self.names[0][0][a])
        words[np.arange(len(b)) + before[1][group_b + 1 if len(both) else group_b]] = np.where(last_b, self.names[1][1][b], self.names[1][0][b])
        starts = np.concatenate([[0], np.cumsum(n_a + n_b)])
        listed = words.tolist()
        return {
            "whole": whole, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(stretch, minlength=len(texts)),
            "code": self.code(link_a, link_b), "fast": one[group] & (self.identity[link_a] == link_b), "of": stretch[group],
            "text": ["".join(listed[i:j])[:-1] for i, j in zip(starts[:-1], starts[1:], strict=True)],
        }


@lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


#: A row of the result before the counts of pairs are known.
DIGEST = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_DIGEST = ", ".join(f"{name}: {'string' if kind == pa.string() else 'bigint'}" for name, kind in DIGEST)
_COUNTS = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))
CHUNK = f"chunk long, digests array<struct<{_DIGEST}>>, sizes binary, places binary, n_links binary, links binary, fast array<struct<code: bigint, n: bigint>>, pairs array<struct<code: bigint, n: bigint>>"


def _blob(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, np.int32).tobytes(), 1)


def _array(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int32)


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``x``, runs of ``sizes`` one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[ends] - total[ends - sizes]


def _counts(codes: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.array([[{"code": c, "n": k} for c, k in zip(codes.tolist(), n.tolist(), strict=True)]], _COUNTS)


class Chunk:
    """Documents that are aligned together: each of their different stretches once."""

    def __init__(self):
        self.chars, self.ids, self.sizes, self.places = 0, [], [], []
        self.stretches: dict[str, int] = {}

    def add(self, doc_id: int | None, text: str | None, aligner: Aligner) -> None:
        place = self.stretches.setdefault
        found = [place(s, len(self.stretches)) for s in (aligner.stretches(text) if text else ())]
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.places.append(np.array(found, np.int32))
        self.chars += len(text or "")

    def aligned(self, chunk: int, aligner: Aligner) -> pa.RecordBatch:
        strings = list(self.stretches)
        found = [aligner.align(strings[i : i + BATCH]) for i in range(0, len(strings), BATCH)] or [aligner.align([])]
        got = {k: np.concatenate([x[k] for x in found]) for k in ("whole", "n_a", "n_b", "n_groups", "code", "fast")}
        of = np.concatenate([x["of"] + i * BATCH for i, x in enumerate(found)])
        texts = [t for x in found for t in x["text"]]
        sizes, places = np.array(self.sizes, np.int64), np.concatenate([np.empty(0, np.int32), *self.places])
        clean = _sums(~got["whole"][places], sizes) == 0
        places, sizes = places[np.repeat(clean, sizes)], np.where(clean, sizes, 0)
        weight = np.bincount(places, minlength=len(strings))
        used = weight[of] > 0
        code, fast, of = got["code"][used], got["fast"][used], of[used]
        n_links = np.bincount(of, minlength=len(strings))
        own = np.bincount(code[fast] // len(aligner.b.bytes), weights=weight[of[fast]], minlength=len(aligner.a.bytes)).astype(np.int64)
        held = np.flatnonzero(own)
        pairs, at = np.unique(code[~fast], return_inverse=True)
        links = np.empty(len(code), np.int64)
        links[fast], links[~fast] = -1 - code[fast] // len(aligner.b.bytes), at
        digest, begin = [], 0
        for n in sizes.tolist():
            digest.append(hashlib.sha256(";".join([texts[i] for i in places[begin : begin + n].tolist()]).encode()).hexdigest() if n else "")
            begin += n
        columns = [pa.array(self.ids, pa.int64()), *(pa.array(_sums(x[places], sizes), pa.int64()) for x in (got["n_a"], got["n_b"], got["n_groups"], n_links)), pa.array(digest)]
        digests = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, names=[n for n, _ in DIGEST]))
        blobs = [pa.array([_blob(x)], pa.binary()) for x in (sizes, places, n_links, links)]
        counts = [_counts(aligner.code(held, aligner.identity[held]), own[held]), _counts(pairs, np.bincount(at, weights=weight[of[~fast]], minlength=len(pairs)).astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), digests, *blobs, *counts], names=["chunk", "digests", "sizes", "places", "n_links", "links", "fast", "pairs"])


def chunked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A written row for each chunk of documents: what CHUNK says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk, n = _aligner(a, b), Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, text.as_py(), aligner)
                if chunk.chars > CHARS or len(chunk.ids) >= DOCUMENTS:
                    yield chunk.aligned(n, aligner)
                    chunk, n = Chunk(), n + 1
        if chunk.ids:
            yield chunk.aligned(n, aligner)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, CHUNK), "align-chunks")


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """code, n, best, fast of each pair: its links, whether its B id has no pair of more, whether the identity map holds it."""
    each = lambda c: chunks.select(F.explode(c).alias("p")).select("p.code", "p.n")
    vector = each("fast").groupBy("code").agg(F.sum("n").alias("n"))  # a row an id of A
    every = vector.withColumn("fast", F.lit(True)).union(each("pairs").withColumn("fast", F.lit(False)))
    counts = saved(every.groupBy("code").agg(F.sum("n").alias("n"), F.max("fast").alias("fast")), "align-pairs")
    most = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("most"))
    best = counts.join(F.broadcast(most), counts["code"] % width == most["b"])  # a row an id of B
    return saved(best.select("code", "n", (F.col("n") == F.col("most")).alias("best"), "fast"), "align-counts")


def align(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """Documents with their tokens' links, and the links' counts over all documents.

    Rows of the first: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A
    and B are the byte-level tokenizer and the one of pieces at the paths ``a`` and ``b``; A
    encodes a space and the text, B the text. A link is a token of each whose bytes overlap; a
    pair's count is how many links of all documents hold it; ``n_best`` counts links whose pair
    has the highest count of its B id, ``count_sum`` adds up the pairs' counts. Rows of the
    second: code (id of A times the size of B, plus id of B), n, best.

    Null and empty texts, and those whose tokens of A or B don't give back the space and the
    text, have zeros and an empty digest, and no part in the counts. Strings of special tokens
    are text. Very long texts are read whole and are a chunk of their own. Repeated rows, and
    rows of one id or none, are documents of their own; ties in counts are all best. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    for_python(spark)
    width = len(PieceBpe(b).bytes)
    chunks = chunked(docs, a, b)
    counts = pair_counts(chunks, width)
    known = [(r.code // width, r.n, r.best) for r in counts.filter("fast").collect()]  # at most a row an id of A
    ids = max([0, *(k[0] for k in known)]) + 1
    vector = np.zeros((2, ids), np.int64)
    for i, n, best in known:
        vector[:, i] = n, best
    shared = spark.sparkContext.broadcast(vector)
    wanted = chunks.select("chunk", F.posexplode("pairs").alias("at", "p")).select("chunk", "at", F.col("p.code").alias("code"))
    found = wanted.join(counts.select("code", "n", "best"), "code").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))  # a chunk's own pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                digests, sizes, places, n_links, links, got = (c.slice(row, 1) for c in batch.columns)
                sizes, places, n_links, links = (_array(x[0].as_py()).astype(np.int64) for x in (sizes, places, n_links, links))
                at, *pairs = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in got.flatten().flatten())
                of = np.zeros((2, len(at)), np.int64)
                for x, y in zip(of, pairs, strict=True):
                    x[at] = y
                fast = links < 0
                per_doc = []
                for mine, vocabulary in ((of[1], best), (of[0], n)):
                    x = np.empty(len(links), np.int64)
                    x[fast], x[~fast] = vocabulary[-1 - links[fast]], mine[links[~fast]]
                    per_doc.append(_sums(_sums(x, n_links)[places], sizes))
                columns = digests.flatten().flatten()
                yield pa.RecordBatch.from_arrays([*columns[:5], *(pa.array(x, pa.int64()) for x in per_doc), columns[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = chunks.drop("fast", "pairs").join(found, "chunk", "left").select("digests", "sizes", "places", "n_links", "links", F.coalesce("found", F.array().cast("array<struct<at: int, n: bigint, best: boolean>>")).alias("found"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), counts.drop("fast")
