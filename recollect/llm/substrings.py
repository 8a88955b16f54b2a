"""Exact substring deduplication by bucket-pointer refinement.

A suffix's bucket holds the suffixes that begin alike; only the first 200 bytes count. Sorting
all suffixes of a corpus would move many times its size, so they are first dealt to groups that
hold all equal strings, and each group is refined for itself.

Grouping. Of the 32-byte q-grams in a 200-byte string the one of least hash, leftmost of equals,
is its anchor. Equal strings have equal anchors at equal offsets; strings that follow each other
and share an anchor are a run, named by its length and hashes of its first and last string.

1. Runs whose anchor is found once are singletons and done.
2. Runs equal as a whole are repeated as a whole, and stand for one run from then on.
3. What is left are different runs around equal anchors: their bytes go to the anchor's group.

Refinement of a group (``refine``). Suffixes are sorted into buckets of their first 8 bytes. A
bucket of suffixes alike in n bytes is sorted again by the identifiers of the buckets that stand
n bytes later, which were refined in the rounds before, so each round doubles n: 8, 16, 32, 64,
128, and 200 by two that overlap. Suffixes alone in their bucket are settled and sorted no more.
Identifiers are ranks, so the refinement compares bytes exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import bucketed, for_python, saved, small

#: Bytes of a repeated string; of an anchor; places of an anchor in a string.
LENGTH, ANCHOR = 200, 32
PLACES = LENGTH - ANCHOR + 1
#: Bytes of text that are refined at once; longer texts are read in overlapping pieces.
PIECE = 1 << 18
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of the bucket made of bucket a and, behind it, bucket b."""
    x = b * _K2
    x ^= x >> np.uint64(31)
    x += a
    x *= _K1
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: the identifier of its bucket of ANCHOR bytes, and of LENGTH bytes."""
    b = data.astype(np.uint64)
    for n in (1, 2, 4):  # q-grams of 8 bytes, exact
        b = b[:-n] | (b[n:] << np.uint64(8 * n))
    for n in (8, 16):
        b = pair(b[:-n], b[n:])
    anchors = b
    for n in (32, 64):
        b = pair(b[:-n], b[n:])
    return anchors, pair(b[: len(data) - LENGTH + 1], b[LENGTH - 128 :])


def least(anchors: np.ndarray) -> np.ndarray:
    """Of each position: where the least of the next PLACES buckets is, the leftmost of equals."""
    at = np.uint64(len(anchors).bit_length())
    order = ((anchors >> np.uint64(20)) << np.uint64(20)) | np.arange(len(anchors), dtype=np.uint64)
    assert at <= 20
    m, n = order, 1
    while 2 * n <= PLACES:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    m = np.minimum(m[: len(order) - PLACES + 1], m[PLACES - n :])
    return (m & np.uint64((1 << 20) - 1)).astype(np.int64)


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """row, start, size, shift, anchor, name of each run of each text.

    A run is ``size`` strings from byte ``start`` on; its anchor lies ``shift`` bytes after
    ``start``; anchor and name are identifiers.
    """
    parts: list[tuple[int, int, bytes]] = []
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE - LENGTH + 1):
            if len(t) - at >= LENGTH:
                parts.append((row, at, t[at : at + PIECE]))
    out: dict[str, list] = {k: [] for k in ("row", "start", "size", "shift", "anchor", "name")}
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j][2]) <= PIECE):
            size += len(parts[j][2])
            j += 1
        sizes = np.array([len(p[2]) for p in parts[i:j]])
        begins = np.cumsum(sizes) - sizes
        anchors, names = buckets(np.frombuffer(b"".join(p[2] for p in parts[i:j]), np.uint8))
        low = least(anchors)
        which = np.repeat(np.arange(j - i), sizes)[: len(low)]
        inside = np.arange(len(low)) - begins[which] <= sizes[which] - LENGTH
        same = np.zeros(len(low) + 1, bool)
        same[1:-1] = (low[1:] == low[:-1]) & inside[1:] & inside[:-1] & (which[1:] == which[:-1])
        first = np.flatnonzero(inside & ~same[:-1])
        last = np.flatnonzero(inside & ~same[1:])
        of = which[first]
        out["row"].append(np.array([p[0] for p in parts[i:j]])[of])
        out["start"].append(first - begins[of] + np.array([p[1] for p in parts[i:j]])[of])
        out["size"].append(last - first + 1)
        out["shift"].append(low[first] - first)
        out["anchor"].append(anchors[low[first]])
        out["name"].append(pair(pair(names[first], names[last]), (last - first + 1).astype(np.uint64)))
        i = j
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}


def refine(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of strings of ``length`` bytes: ``sizes`` of them from each of ``begins`` on.

    Equal identifiers mean equal bytes. ``data`` is the stretches side by side, each followed by
    the ``length`` - 1 bytes that its last string needs.
    """
    starts = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    q = data.astype(np.uint64)
    for n in (1, 2, 4):
        q = q[:-n] | (q[n:] << np.uint64(8 * n))
    ids = np.zeros(len(data), np.int64)
    ids[: len(q)] = np.unique(q, return_inverse=True)[1]
    alike = 8
    while alike < length:
        later = min(alike, length - alike)
        whole = starts if alike + later == length else np.arange(len(data) - alike)
        count = np.bincount(ids)
        open_ = whole[count[ids[whole]] > 1]  # the rest are alone in their buckets
        pair_ = ids[open_] << 32 | ids[open_ + later]
        # Ranks go on after those in use: what is settled keeps its own.
        ids[open_] = len(count) + np.unique(pair_, return_inverse=True)[1]
        alike += later
    return ids[starts]


def pack(tag: np.ndarray, start: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """tag (7 bits), start (40), size (8) and shift (8) as one bigint."""
    return (tag.astype(np.int64) << 56) | (start.astype(np.int64) << 16) | (size.astype(np.int64) << 8) | shift.astype(np.int64)


def begin_of(pos):
    return pos >> 16 & 0xFFFFFFFFFF


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_py().encode("utf-8", "surrogatepass") for t in column]


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        r = runs(_texts(b.column(2)))
        row = r["row"].astype(np.int64)
        columns = [b.column(0).to_numpy()[row], pack(b.column(1).to_numpy()[row], r["start"], r["size"], r["shift"]), r["anchor"].view(np.int64), r["name"].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "pos", "anchor", "name"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for b in small(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze.compress(t) for t in _texts(b.column(2))], pa.binary())], names=["k", "tag", "z"])


def _runs_to_refine(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, dict]]:
    import zstandard

    for k, z, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
        text = zstandard.ZstdDecompressor().decompress(z.as_py())
        for r in found:
            yield k, text, r


STRETCH = pa.schema([("anchor", pa.int64()), ("k", pa.int64()), ("pos", pa.int64()), ("weight", pa.int64()), ("data", pa.binary())])
STRING = pa.schema([("anchor", pa.int64()), ("name", pa.int64()), ("k", pa.int64()), ("pos", pa.int64()), ("weight", pa.int64())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run to refine."""
    for b in small(batches):
        out: list[tuple] = []
        for k, text, r in _runs_to_refine(b):
            start, size = begin_of(r["pos"]), r["pos"] >> 8 & 0xFF
            out.append((r["anchor"], k, r["pos"], r["weight"], text[start : start + size + LENGTH - 1]))
            if len(out) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(STRETCH)], schema=STRETCH)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(STRETCH)], schema=STRETCH)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of each run of a large group, with the identifier of its bucket of LENGTH bytes."""
    for b in small(batches):
        for k, text, r in _runs_to_refine(b):
            start, size = begin_of(r["pos"]), r["pos"] >> 8 & 0xFF
            names = buckets(np.frombuffer(text, np.uint8, size + LENGTH - 1, start))[1].view(np.int64)
            fixed = [np.full(size, x, np.int64) for x in (r["anchor"], k, r["weight"], r["pos"] >> 56)]
            pos = pack(fixed[3], start + np.arange(size), np.ones(size, np.int64), np.zeros(size, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fixed[0], names, fixed[1], pos, fixed[2])], schema=STRING)


def _repeated(rows: pa.Table) -> pa.RecordBatch:
    """(k, pos) of the parts of runs that another run of ``rows``, all of whole groups, holds too."""
    out: list[tuple[int, int]] = []
    if rows.num_rows > 1:
        ks, positions, weights = (rows.column(c).to_numpy() for c in ("k", "pos", "weight"))
        data = rows.column("data").to_pylist()
        sizes = np.array([len(d) for d in data])
        counts = sizes - LENGTH + 1
        ids = refine(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, counts)
        twice = np.bincount(ids, np.repeat(weights, counts))[ids] > 1
        first = np.cumsum(counts) - counts
        for i in np.flatnonzero((weights == 1) & (np.add.reduceat(twice, first) > 0)).tolist():
            hit = np.flatnonzero(twice[first[i] : first[i] + counts[i]])
            cuts = np.flatnonzero(np.diff(hit) > 1)
            begin, end = hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])]
            out += [(ks[i], p) for p in pack(positions[i] >> 56, begin_of(positions[i]) + begin, end - begin + 1, np.zeros(len(begin))).tolist()]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["k", "pos"])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by anchor, refining the groups that are complete."""
    held: pa.Table | None = None
    for b in small(batches):
        rows = pa.Table.from_batches([b])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        anchor = rows.column("anchor").to_numpy()
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1])
        done = int(cuts[-1]) + 1 if len(cuts) else 0
        yield _repeated(rows.slice(0, done))
        held = rows.slice(done)
    if held is not None:
        yield _repeated(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes what the spans cover."""
    import zstandard

    for b in small(batches):
        out = []
        for z, found in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            text = zstandard.ZstdDecompressor().decompress(z.as_py())
            kept, at, removed, n = [], 0, 0, 0
            end = -1
            for begin, size in sorted((begin_of(p), p >> 8 & 0xFF) for p in found or ()):
                stop = begin + size - 1 + LENGTH
                if begin > end:  # not even touching
                    kept.append(text[at:begin])
                    n += 1
                    removed += stop - begin
                    at = end = stop
                elif stop > end:
                    removed += stop - end
                    at = end = stop
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if n else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], names=["k", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


#: Runs of a group up to which one task refines it; a larger one is counted by Spark.
PART = 16_384


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row, text as UTF-8 bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in any
    row's text, itself included; strings are judged on the input. ``kept`` is the rest where
    anything goes, without bytes of characters that were cut in two; null where nothing goes.

    Null text counts as empty; texts under LENGTH bytes keep all, very long ones are read in
    pieces. A text is told by 71 bits of hash, whatever its rows' doc_ids
    (of a billion different texts two are taken for one with a chance of 1 in 4,000): rows of one doc_id,
    or of none, each get a result, and copies of a row are repeated text, refined and cut once.
    An empty table gives an empty result; other columns are ignored.

    A common passage's runs are counted before they are shuffled and joined in a join that Spark
    can split. Groups of over PART different runs aren't gathered: their strings are counted by
    the identifiers of their 200-byte buckets, made by the same doubling from hashes of 64 bits
    (equal strings are taken for repeated if both anchor and identifier agree). Texts are
    shuffled once, compressed, copies collapsed before.
    """
    for_python(docs.sparkSession)
    key = ["k", "tag"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(127)).alias("tag"), text.alias("text"))
    found = source.select(*key, "text").mapInArrow(_find_runs, "k long, pos long, anchor long, name long")
    packed = source.select(*key, "text").mapInArrow(_compress, "k long, tag long, z binary").groupBy(*key).agg(F.first("z").alias("z"))
    packed = bucketed(packed, "substrings-texts", key, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # both joins below find it in its buckets
    tagged = F.shiftright("pos", 56).alias("tag")

    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("low"), F.max("name").alias("high")).filter("n > 1")
    anchors = saved(anchors.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "substrings-anchors")  # read back, so that Spark can split the join's large keys
    told = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)  # noqa: E731 - the rest are whole runs, of which only places count from here on
    near = saved(found.join(anchors.hint("merge"), "anchor").select("k", "pos", told("anchor"), told("name"), "mixed"), "substrings-near")  # anchors grow with the corpus: not broadcast at any size
    # Any run of a class can stand for it: what it says of its class is the same.
    classes = near.filter("mixed").groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("weight"), F.first("k").alias("k"), F.first("pos").alias("pos"))
    classes = saved(classes, "substrings-classes")
    again = near.filter("mixed").join(classes.filter("weight > 1").select("anchor", "name").hint("merge"), ["anchor", "name"]).select("k", "pos")
    whole = near.filter("not mixed").select("k", "pos").union(saved(again, "substrings-again"))  # a join alone, which Spark can split
    large = saved(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART).select("anchor"), "substrings-large")
    any_large = not large.isEmpty()

    def of_texts(runs_: DataFrame) -> DataFrame:
        todo = runs_.groupBy("k", tagged).agg(F.collect_list(F.struct("anchor", "pos", "weight")).alias("runs"))  # one text's
        return packed.join(todo.hint("shuffle_hash"), key).select("k", "z", "runs")

    small = of_texts(classes.join(large, "anchor", "left_anti") if any_large else classes).mapInArrow(_stretches, "anchor long, k long, pos long, weight long, data binary")
    parts = whole.union(small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_refine, "k long, pos long"))
    if any_large:
        strings = saved(of_texts(classes.join(large, "anchor", "left_semi")).mapInArrow(_strings, "anchor long, name long, k long, pos long, weight long"), "substrings-strings")
        twice = strings.groupBy("anchor", "name").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor", "name")
        parts = parts.union(saved(strings.filter("weight = 1").join(saved(twice, "substrings-twice"), ["anchor", "name"]).select("k", "pos"), "substrings-found"))
    spans = parts.groupBy("k", tagged).agg(F.collect_set("pos").alias("spans"))  # one text's: copies have equal places
    done = packed.join(spans.hint("shuffle_hash"), key, "left").select(*key, "z", "spans")
    done = done.mapInArrow(_cut, "k long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return source.select("doc_id", *key).join(done, key).drop(*key)
