"""SimHash near-duplicates: fingerprints, links by the pigeonring, components; and rows without
near copies by the Jaccard similarity of their shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import for_python, fresh, saved, small

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Ring: 4 segments of 16 bits, and at most 3 differing bits.
SEGMENTS, BITS, MOST = 4, 16, 3
#: Bands of least hashes, and least hashes of a band, that find candidates by Jaccard similarity.
BANDS, ROWS = 40, 5
#: A set of shingles' SimHash has 64 x WIDE bits. At a Jaccard of 0.8 two differ in 39 of 256 on
#: average, spread 6; MOST_WIDE lies 7 spreads above, CHAIN is the pigeonring's chain there.
WIDE, MOST_WIDE, CHAIN = 4, 80, 3
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Shingles that a part of a band holds.
MEMORY = 2_000_000
#: Members of a bucket that are compared with each other at once.
CHUNK = 1024


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the XXH64 of a text's word shingles, repeats included.

    Words are maximal runs of other than ASCII white space, A-Z lower-cased. Fewer words than
    a shingle make one shingle; none, or null text, give zero. A bit is one if it is set in
    over half the hashes.
    """
    if not text:
        return 0
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash as a signed bigint, of each row's whole text."""
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def keys(fp):
    """array<struct<slot, key>>: what two linked fingerprints share in at least one place.

    By the pigeonring, fingerprints within 3 bits have a segment from which, around the ring,
    the first 1, 2, 3, 4 segments differ in at most 0, 1, 2, 3 bits. So that segment is equal
    and one half of the segment after it is: 4 x 2 keys of 24 bits.
    """
    out = []
    for i in range(SEGMENTS):
        turned = F.shiftleft(fp, BITS * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * i)) if i else fp
        first = F.shiftrightunsigned(turned, 48)
        second = F.shiftrightunsigned(turned, 32).bitwiseAND(F.lit(0xFFFF))
        for half, part in enumerate((F.shiftright(second, 8), second.bitwiseAND(F.lit(0xFF)))):
            out.append((F.shiftleft(first, 8) + part) * F.lit(2 * SEGMENTS) + F.lit(2 * i + half))
    return F.array(*out)


def linked(a: np.ndarray, b: np.ndarray, segment: int) -> np.ndarray:
    """Which of a x b are linked: the chain of segments from ``segment`` first, then all bits."""
    x = a[:, None] ^ b[None, :]
    if segment:
        x = (x << np.uint64(BITS * segment)) | (x >> np.uint64(64 - BITS * segment))
    ok = np.bitwise_count(x >> np.uint64(32)) <= 1
    i, j = np.nonzero(ok)
    y = x[i, j]
    keep = np.bitwise_count(y >> np.uint64(16)) <= 2
    i, j, y = i[keep], j[keep], y[keep]
    keep = np.bitwise_count(y) <= MOST
    return np.stack([i[keep], j[keep]])


def forest(a: np.ndarray, b: np.ndarray, segment: int) -> list[tuple[int, int]]:
    """Links among a and b that connect all that is linked: a tree's worth, not all pairs."""
    nodes = np.unique(np.concatenate([a, b]))
    if len(nodes) == 2:
        return [(int(nodes[0]), int(nodes[1]))] if linked(nodes[:1], nodes[1:], segment).size else []
    pairs = linked(a, b, segment)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(np.searchsorted(nodes, a[pairs[0]]).tolist(), np.searchsorted(nodes, b[pairs[1]]).tolist(), strict=True):
        if (p := root(i)) != (q := root(j)):
            up[max(p, q)] = min(p, q)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def longer(fp: Column, key: Column) -> Column:
    """array<int>: what two linked fingerprints of one key share in at least one place, further along the chain.

    The first three segments differ in at most 2 bits, the first and half of the second in none:
    so of the other half and the two halves of the third, 8 bits each, one is equal.
    """
    turn, half = F.floor(F.pmod(key, F.lit(2 * SEGMENTS)) / 2).cast("int") * BITS, F.pmod(key, F.lit(2))
    turned = F.when(turn == 0, fp).otherwise(F.call_function("shiftleft", fp, turn).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - turn)))
    byte = lambda n: F.shiftrightunsigned(turned, n).bitwiseAND(F.lit(0xFF))
    return F.array(F.when(half == 0, byte(32)).otherwise(byte(40)), byte(24) + 256, byte(16) + 512).cast("array<int>")


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """src < dst of distinct fingerprints (column fp) whose links connect all that is linked.

    A bucket is the fingerprints with one key. One of over ``chunk`` members is dealt anew by the
    chain's next bits; what is still larger is cut into chunks, and each pair of chunks is a
    task's work of its own, so that a large bucket is spread and nothing is left out.
    """

    def sized(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        return rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1), by)

    held = sized(fps.select("fp", F.explode(keys(F.col("fp"))).alias("key")), ["key"], "n")
    more = F.when(F.col("n") > chunk, longer(F.col("fp"), F.col("key"))).otherwise(F.array(F.lit(-1)))
    held = sized(held.select("fp", "key", F.explode(more).alias("more")), ["key", "more"], "m")
    held = held.withColumn("parts", F.ceil(F.col("m") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    held = held.withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = held.select("fp", "key", "more", "mine", other.alias("other"))
    dealt = dealt.select("fp", "key", "more", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    dealt = dealt.repartition("key", "more", "i", "j").sortWithinPartitions("key", "more", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: np.ndarray) -> list[tuple[int, int]]:
            fp, segment = part[:, 0].view(np.uint64), int(part[0, 1] % (2 * SEGMENTS)) // 2
            if part[0, 3] == part[0, 4]:
                return forest(fp, fp, segment)
            low = part[:, 5] == part[0, 3]
            return forest(fp[low], fp[~low], segment)

        carried = np.empty((0, 6), np.int64)
        for b in small(batches):
            rows = np.concatenate([carried, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)])
            new = np.flatnonzero((rows[1:, 1:5] != rows[:-1, 1:5]).any(1)) + 1
            found = []
            for s, e in zip([0, *new.tolist()], new.tolist(), strict=False):
                found += pairs(rows[s:e])
            carried = rows[new[-1] :] if len(new) else rows
            yield batch(found)
        if len(carried):
            yield batch(pairs(carried))

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x[:, 0], x[:, 1])), pa.array(np.maximum(x[:, 0], x[:, 1]))], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (src, dst): root is the least node reachable.

    Alternates large-star and small-star steps until the edges are stars around their roots:
    O(log^2 n) rounds whatever the shape of a component. Minima are aggregates, so a hub
    isn't gathered anywhere. Each round is written to the shared folder.
    """
    edges = saved(edges.select("src", "dst").filter("src <> dst").distinct(), "components")
    state = None
    while True:
        both = edges.union(edges.select("dst", "src")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = saved(small.filter("u <> v").distinct().select(F.col("v").alias("src"), F.col("u").alias("dst")), "components")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("dst").alias("node"), F.col("src").alias("root")).union(edges.select("src", "src").distinct())
        state = now


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row: component_id is the least doc_id reachable.

    Rows whose fingerprints differ in at most 3 bits are linked. Equal fingerprints are made
    one before the search, so a group of copies of any size is one node of it. Null and blank
    texts have fingerprint zero and are linked like any other; a very long text is read whole, all
    its shingles counted. Null doc_ids are kept, and
    count for component_id only if no other id is reachable. Repeated rows are repeated in
    the result. An empty table gives an empty result; other columns are ignored.
    """
    rows = saved(fingerprints(docs, words), "simhash-rows")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, in order; words as in ``fingerprint``."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + words])) for i in range(max(1, len(found) - words + 1))), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS numbers: each of the least of the hashes in ROWS of the random orders."""
    draw = np.random.default_rng(1).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    times, plus = draw[0] | np.uint64(1), draw[1]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * times + plus).min(1))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - 2**63 for i, part in enumerate(least.reshape(BANDS, ROWS))]


def wide(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes in 64 x WIDE bits, as WIDE signed numbers."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384, None] * MIXERS
        part ^= part >> np.uint64(32)
        counts += np.unpackbits((part * MIXERS).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist()


def ring(x: Column, y: Column) -> Column:
    """Whether two wide SimHashes pass the pigeonring and the full Hamming check.

    2 x WIDE segments of 32 bits stand in a ring. If at most MOST_WIDE bits differ, some segment
    begins a chain whose first 1, 2, 3 segments differ in at most as many shares of MOST_WIDE.
    """
    apart = F.flatten(F.zip_with(x, y, lambda a, b: F.array(F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 32)), F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF))))))

    def passes(d: Column) -> Column:
        n, found = 2 * WIDE, F.lit(False)
        for begin in range(n):
            sums = [reduce(add, (F.get(d, (begin + k) % n) for k in range(length))) * n <= length * MOST_WIDE for length in range(1, CHAIN + 1)]
            found |= reduce(and_, sums)
        return found & (F.aggregate(d, F.lit(0), lambda s, b: s + b) <= MOST_WIDE)

    return F.element_at(F.transform(F.array(apart), passes), 1)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t, node, fp, size, bands of each row.

    t is the text's hash, node its set of shingles' hash, fp the set's wide SimHash.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingles(t.as_py(), words) for t in b.column(2)]
            nodes = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets]
            lists = ([wide(s) for s in sets], [bands(s) if len(s) else [] for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["doc_id", "t", "node", "size", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, t long, node long, size long, fp array<long>, bands array<long>")


def sets_of(asked: DataFrame, known: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, s: the set of shingles of each distinct node of ``asked``, computed again from one text of it.

    ``known`` has node and t, the hash of one of its texts.
    """
    wanted = known.join(asked.select("node").distinct(), "node", "left_semi").select("node", "t")
    texts = docs.select(F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text")).join(wanted, "t").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["node", "s"])

    return saved(texts.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, s array<long>"), "similar-sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of ``pairs`` of nodes (src, dst) those whose sets of shingles have a Jaccard of at least ``least``."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("s").alias("x")), "src").join(sets.select(F.col("node").alias("dst"), F.col("s").alias("y")), "dst")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(least) * (F.size("x") + F.size("y") - common)).select("src", "dst")


def ring_pairs(fp: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` pass ``ring`` with ``fp``."""
    n = 2 * WIDE
    d = np.bitwise_count((others ^ fp).view(np.uint32)).astype(np.int64)
    ahead = np.concatenate([d, d], 1)
    sums, chains = np.zeros_like(d), np.ones(d.shape, bool)
    for length in range(1, CHAIN + 1):
        sums += ahead[:, length - 1 : length - 1 + n]
        chains &= sums * n <= length * MOST_WIDE
    return chains.any(1) & (d.sum(1) <= MOST_WIDE)


def tree(nodes: np.ndarray, roots: np.ndarray, probe: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a probe and a node that is none which connect what is similar: a tree's worth."""
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    own = np.unique(roots, return_inverse=True)[1].copy()  # the component of each, as links join them
    mark, out = np.zeros(len(ids), np.uint8), []
    for i in np.flatnonzero(probe).tolist():
        other = np.flatnonzero(~probe & (own != own[i]))
        other = other[ring_pairs(fps[i], fps[other])]
        if not len(other):
            continue
        mine = flat[begins[i] : begins[i] + sizes[i]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat], begins, dtype=np.int32)[other]
        mark[mine] = 0
        for j in other[common >= least * (sizes[i] + sizes[other] - common)].tolist():
            if own[i] != own[j]:
                own[own == own[j]] = own[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def rest_links(held: DataFrame, known: DataFrame, sets: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """Links that connect what is similar among the nodes of each key of ``held`` (key, node, root).

    ``known`` has node, fp and size. Nodes of a key's largest component need no comparison with
    each other: the rest, the probes, are held against all. Both are cut into parts of about
    ``chunk`` nodes or MEMORY shingles, and each part of probes against each part of nodes is a
    task's work of its own, so that a large key is spread and no pair is left out. A task gives
    a tree, not all pairs.
    """
    nodes = saved(held.join(known.select("node", "size"), "node"), "similar-rest")
    sums = nodes.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sums = sums.groupBy("key").agg(F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / chunk), F.ceil(size / MEMORY), F.lit(1)).cast("int")

    dealt = sums.select("key", F.col("main.root").alias("most"), parts(F.col("n"), F.col("size")).alias("parts"), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("turns"))
    nodes = nodes.join(saved(dealt, "similar-parts"), "key")
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = nodes.select("key", "node", "root", F.lit(False).alias("probe"), deal("parts", 0).alias("part"), every("turns").alias("turn"))
    probes = nodes.filter("root <> most").select("key", "node", "root", F.lit(True).alias("probe"), every("parts").alias("part"), deal("turns", 1).alias("turn"))
    work = saved(base.union(probes), "similar-work").join(known.select("node", "fp").join(sets, "node"), "node")

    def run(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).combine_chunks()
        fps = column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
        sets = [x.values.to_numpy() for x in column("s")]
        found = tree(column("node").to_numpy(), column("root").to_numpy(), column("probe").to_numpy(zero_copy_only=False), fps, sets, least)
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return work.groupBy("key", "part", "turn").applyInArrow(run, "src long, dst long")


def similar_links(rows: DataFrame, docs: DataFrame, words: int, least: float, chunk: int = CHUNK) -> DataFrame:
    """Links that connect all nodes of ``rows`` (see ``sketches``) that are similar and share a band.

    First each node is held against the least of its band; then, in bands that are still of
    several components, nodes of different components are held against each other. The
    pigeonring prunes both before the sets of shingles are compared.
    """
    known = saved(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("t").alias("t")), "similar-nodes")
    nodes = rows.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    keyed = saved(nodes.select("node", F.explode("bands").alias("key")), "similar-bands")
    centres = keyed.groupBy("key").agg(F.min("node").alias("src"), F.max("node").alias("last")).filter("src <> last").drop("last")
    held = saved(keyed.join(centres, "key"), "similar-shared")
    first = held.filter("src <> node").select("src", F.col("node").alias("dst")).distinct()
    ends = [known.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}")) for end in ("src", "dst")]
    first = first.join(ends[0], "src").join(ends[1], "dst").filter(ring(F.col("fp_src"), F.col("fp_dst")))
    first = saved(first.select("src", "dst"), "similar-pairs")
    sets = sets_of(first.select(F.col("src").alias("node")).union(first.select("dst")), known, docs, words)
    linked_ = saved(similar(first, sets, least), "similar-links")
    placed = held.join(components(linked_), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    placed = saved(placed.join(mixed, "key", "left_semi"), "similar-mixed")
    return linked_.union(rest_links(placed, known, sets_of(placed, known, docs, words), least, chunk))


def first_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the least doc_id's row.

    Rows are linked if the Jaccard similarity of their texts' sets of word shingles is at least
    ``least``, which is computed exactly for all that share one of BANDS bands of ROWS least
    hashes; at 0.8 a pair shares none with a chance of (1 - 0.8^5)^40, about 1 in 8 million.
    Texts without words are alike. A row is told by its doc_id and its text's 64-bit hash; null
    ids come last. Of rows with one doc_id that of the least such hash stays, of repeated rows one.
    """
    rows = saved(sketches(docs, words), "similar-rows")
    roots = components(similar_links(rows, docs, words, least))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t")
    named = rows.groupBy("node").agg(F.min(own).alias("k")).join(roots, "node", "left")  # copies of a text collapse before the join
    best = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    none, key, text, n = fresh(docs, "none", "key", "text_key", "copy")
    kept = best.select(F.col("k.none").alias(none), F.col("k.id").alias(key), F.col("k.t").alias(text))
    id_ = F.col("doc_id").cast("long")
    stay = docs.withColumns({none: id_.isNull(), key: F.coalesce(id_, F.lit(0)), text: F.xxhash64("text")}).join(kept.hint("shuffle_hash"), [none, key, text], "left_semi")
    one = F.row_number().over(Window.partitionBy(none, key, text).orderBy("text"))
    return stay.withColumn(n, one).filter(F.col(n) == 1).select(docs.columns)
