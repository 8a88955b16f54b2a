"""Graph queries over an edge table: source_id, target_id, relationship, strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.shared import saved, spread

#: What an id, a type of relation and a number of hops may be before they enter a query.
ID, RELATION, MOST_HOPS = "^[A-Za-z0-9_-]{1,256}$", "^[A-Za-z0-9_-]{1,128}$", 6


def refused(id_: Column, relationship: Column | None = None, hops: Column | None = None) -> Column:
    """Why a request isn't let through: ``id``, ``relationship`` or ``hops``; null if it is."""
    bad = lambda c, pattern: ~F.coalesce(c.rlike(pattern), F.lit(False))
    out = F.lit(None).cast("string") if hops is None else F.when(~F.coalesce(hops.between(1, MOST_HOPS), F.lit(False)), "hops")
    if relationship is not None:
        out = F.when(bad(relationship, RELATION), "relationship").otherwise(out)
    return F.when(bad(id_, ID), "id").otherwise(out)


def admitted(edges: DataFrame, relationships: list[str] | None = None) -> DataFrame:
    return edges.filter(F.col("relationship").isin(relationships)) if relationships else edges


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of each edge, read from either end."""
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return e.union(e.select("dst", "src")).toDF("src", "dst")


def steps(edges: DataFrame, direction: str) -> DataFrame:
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    if direction == "outgoing":
        return e
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "incoming" else both_ways(edges)


def k_hop(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both", limit: int | None = None) -> DataFrame:
    """root, node, depth of the nodes within ``depth`` steps of each root (column node), itself at 0.

    All of them, a row for each root and node. Roots with one way out share the search from where
    it leads, and their rows are made as they are read, so many roots around one hub write and
    shuffle no more than their edges and the hub's nodes, see ``_shared``. With ``limit`` a root
    keeps itself and the least others; no more than these are followed, see ``_balls``.
    ``within_hops`` has the nodes alone.
    """
    _check_depth(depth)
    if limit is not None:
        return _kept(_balls(edges, roots, depth, direction, limit), limit)
    step = saved(steps(edges, direction).filter("src <> dst").distinct(), "graph-steps")
    single = step.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("hub")).filter("n = 1").select(F.col("src").alias("node"), "hub")
    asked = saved(roots.select("node").distinct().join(single, "node", "left"), "graph-roots")
    leaves, inner = asked.filter("hub is not null").select(F.col("node").alias("root"), "hub"), asked.filter("hub is null").select(F.col("node").alias("root"))
    starts = inner.select("root", F.lit(depth).alias("left")).union(leaves.select("hub", F.lit(depth - 1))).groupBy("root").agg(F.max("left").alias("left"))
    seen = frontier = saved(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), "left"), "graph-frontier")
    for d in range(1, depth + 1):
        reached = frontier.filter(F.col("left") >= d).join(step, frontier["node"] == step["src"]).select("root", F.col("dst").alias("node"), "left").distinct()
        frontier = saved(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"), "left"), "graph-frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    own = asked.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    further = seen.filter("depth > 0").join(inner, "root", "left_semi").select("root", "node", "depth")
    return own.union(further).union(_shared(leaves, seen.filter(F.col("depth") < depth).select(F.col("root").alias("hub"), "node", "depth")))


#: Nodes around a hub that meet its roots in one place, about.
AROUND = 10_000


def _shared(leaves: DataFrame, around: DataFrame) -> DataFrame:
    """root, node, depth of each leaf (root, hub): the nodes around its hub (hub, node, depth), itself left out, a step later.

    The nodes around a hub are dealt out and its leaves sent to each part, so no task has all
    rows of a hub, and what a task holds at once is a part.
    """
    held = around.join(leaves.select("hub").distinct(), "hub", "left_semi")
    parts = saved(held.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / AROUND).cast("int").alias("parts")), "graph-parts")
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = leaves.join(parts, "hub").select("root", "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(n, "hub", "part")
    dealt = held.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "depth").repartition(n, "hub", "part")
    pairs = to.join(dealt.hint("merge"), ["hub", "part"]).filter("node <> root")
    return pairs.select("root", "node", (F.col("depth") + 1).alias("depth"))


def _check_depth(depth: int) -> None:
    if not 1 <= depth <= MOST_HOPS:
        raise ValueError(f"depth must be 1 to {MOST_HOPS}")


def within_hops(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """node: all within ``depth`` steps of any root (column node), each once."""
    _check_depth(depth)
    step = steps(edges, direction)
    seen = frontier = saved(roots.select("node").distinct(), "graph-frontier")
    for _ in range(depth):
        reached = step.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = saved(reached.join(seen, "node", "left_anti"), "graph-frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def _balls(edges: DataFrame, roots: DataFrame, depth: int, direction: str, limit: int) -> DataFrame:
    """root, node, depth of the ``limit`` + 1 least nodes within ``depth`` steps of each root, all if there are no more.

    The least nodes around a node are among itself and the least around its neighbours, and a
    node that is among the least around it is so around the neighbour on the shortest way to it.
    So balls grow from the far end, a radius a round, none beyond ``limit`` + 1 nodes: a hub hands
    these to its neighbours, not all of its own.
    """
    step = saved(steps(edges, direction).distinct(), "graph-steps")
    wanted = [saved(roots.select("node").distinct(), "graph-wanted")]  # whose balls of radius depth, depth - 1, ... count
    for _ in range(depth):
        wanted.append(saved(step.join(wanted[-1].withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "graph-wanted"))
    least = Window.partitionBy("root").orderBy("node")
    own = lambda nodes: nodes.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    balls = own(wanted[depth])
    for nodes in reversed(wanted[:depth]):
        arcs = step.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
        further = arcs.join(balls, arcs["dst"] == balls["root"]).select(F.col("src").alias("root"), "node", (F.col("depth") + 1).alias("depth"))
        grown = further.union(own(nodes)).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        balls = saved(grown.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= limit + 1).drop("n"), "graph-balls")
    return balls


def _kept(balls: DataFrame, limit: int) -> DataFrame:
    """Of each root itself and the least others, ``limit`` in all; itself even where the ball was cut before it."""
    others = balls.filter("node <> root")
    own = balls.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    first = Window.partitionBy("root").orderBy("node")
    return own.union(others.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit - 1).drop("n"))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both", limit: int = 50, relationships: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """root, node, depth, truncated of the nodes that each root keeps, and root, source_id, target_id, relationship, strength of the edges among them.

    A root keeps itself and the least others up to ``limit``; it is truncated if there were more.
    Steps and edges are of the ``relationships`` alone, if any are named.
    """
    _check_depth(depth)
    own = admitted(edges, relationships)
    near = _balls(own, roots, depth, direction, limit)
    counts = near.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", (F.col("n") > limit).alias("truncated"))
    kept = saved(_kept(near, limit).join(counts, "root").select("root", "node", "depth", "truncated"), "graph-kept")
    ends = kept.select("root", "node")
    nodes = ends.select("node").distinct()  # of a hub's edges only those to kept nodes meet its roots
    among = ends.join(induced(own, nodes), F.col("node") == F.col("source_id")).drop("node")
    return kept, among.join(ends.withColumnRenamed("node", "target_id"), ["root", "target_id"], "left_semi").select("root", "source_id", "target_id", "relationship", "strength")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    n = nodes.select("node").distinct()
    kept = edges.join(n.withColumnRenamed("node", "source_id"), "source_id", "left_semi")
    return kept.join(n.withColumnRenamed("node", "target_id"), "target_id", "left_semi")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """source, target, hops, path of the shortest undirected path of each pair, up to ``most`` hops.

    Of equal length the least sequence of nodes. A node with one neighbour (a leaf) is on a path
    only as an end, so an end that is one stands for its neighbour, and only others are searched
    among: the leaves of a hub are no frontier, and pairs between them are searched once for
    the pair of their hubs. One path a node and source is kept a step: the least, whose
    continuations are least as well. Sources whose targets are all found go on no further.
    """
    step = saved(both_ways(edges).filter("src <> dst").distinct(), "graph-steps")
    leaves = saved(step.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("hub")).filter("n = 1").select(F.col("src").alias("leaf"), "hub"), "graph-leaves")
    inner = saved(step.join(leaves.withColumnRenamed("leaf", "dst"), "dst", "left_anti").select("src", "dst"), "graph-inner")
    own = lambda end: leaves.select(F.col("leaf").alias(end), F.col("hub").alias(f"{end}_hub"))
    found = pairs.select("source", "target").distinct().join(own("source"), "source", "left").join(own("target"), "target", "left")
    adjacent = F.coalesce((F.col("source_hub") == F.col("target")) | (F.col("target_hub") == F.col("source")), F.lit(False))
    near = (F.col("source") == F.col("target")) | adjacent
    ends = [F.coalesce(f"{end}_hub", end).alias(f"{end[0]}_inner") for end in ("source", "target")]
    spent = F.col("source_hub").isNotNull().cast("int") + F.col("target_hub").isNotNull().cast("int")
    found = saved(found.select("source", "target", near.alias("near"), *ends, spent.alias("spent")), "graph-pairs")
    path = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    out = found.filter("near").select("source", "target", (F.size(path) - 1).alias("hops"), path.alias("path")).filter(F.col("hops") <= most)
    far = found.filter("not near")
    asked = far.groupBy("s_inner", "t_inner").agg(F.min("spent").alias("spent")).select(F.col("s_inner").alias("source"), F.col("t_inner").alias("target"), (most - F.col("spent")).alias("left"))
    reach = saved(asked.select("source", F.col("source").alias("node"), F.array("source").alias("path")).distinct(), "graph-reached")
    seen, paths = reach.select("source", "node"), asked.filter("source = target and left >= 0").select("source", "target", F.lit(0).alias("hops"), F.array("source").alias("path"))
    asked = saved(asked.filter("source <> target and left > 0"), "graph-asked")
    for hops in range(1, most + 1):
        if asked.isEmpty():
            break
        reach = reach.join(asked.select("source"), "source", "left_semi")
        longer = reach.join(inner, reach["node"] == inner["src"]).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        reach = saved(longer.join(seen, ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path")), "graph-reached")
        if reach.isEmpty():
            break
        seen = seen.union(reach.select("source", "node"))
        hit = saved(asked.join(reach.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", F.lit(hops).alias("hops"), "path"), "graph-paths")
        paths = paths.union(hit)
        asked = saved(asked.filter(F.col("left") > hops).join(hit, ["source", "target"], "left_anti"), "graph-asked")
    between = paths.select(F.col("source").alias("s_inner"), F.col("target").alias("t_inner"), F.col("hops").alias("h"), F.col("path").alias("p"))
    outer = lambda end: F.when(F.col(end) == F.col(f"{end[0]}_inner"), F.array().cast("array<string>")).otherwise(F.array(end))
    whole = far.join(between, ["s_inner", "t_inner"]).select("source", "target", (F.col("h") + F.col("spent")).alias("hops"), F.concat(outer("source"), "p", outer("target")).alias("path"))
    return out.union(whole.filter(F.col("hops") <= most))


def traversal(edges: DataFrame, start: DataFrame, depth: int = 3, direction: str = "outgoing") -> DataFrame:
    """start, node, depth, path, total_strength: a row for each extension of a path without revisits.

    total_strength is the last edge's strength.
    """
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "strength")
    if direction != "outgoing":
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength")
        e = back if direction == "incoming" else e.union(back)
    at = start.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    out = None
    for d in range(1, depth + 1):
        at = at.join(e, at["node"] == e["src"]).filter(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.col("strength").alias("total_strength"))
        rows = at.select("start", "node", F.lit(d).alias("depth"), "path", "total_strength")
        out = rows if out is None else out.union(rows)
    return out


def rollup(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """a < b, relationship, strength: one undirected edge a pair; the last by (source, target, relationship, strength) wins.

    Few edges share a pair, so they are shuffled as they are, and sorted once, by tasks that get no more with more edges.
    """
    e = F.struct((F.col("source_id") > F.col("target_id")).alias("back"), "relationship", "strength")
    ends = edges.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), e.alias("e"))
    last = spread(ends, edges.count(), "a", "b").groupBy("a", "b").agg(F.max("e").alias("e"))
    return last.select("a", "b", "e.relationship", "e.strength")


def comention(members: DataFrame, seeds: DataFrame | Column, rows: int | None = None) -> DataFrame:
    """entity_id, other, shared: in how many memories a seed entity and another are both mentioned.

    Seeds are rows of entity_id, or a condition on it. ``rows`` tells about how many rows members
    have; then they are shuffled by memory, once, into partitions for as many. Members shuffled so
    already need no ``rows``.
    """
    m = members.select("entity_id", "memory_id")
    m = (m if rows is None else spread(m, rows, "memory_id")).distinct()
    asked = m.filter(seeds) if isinstance(seeds, Column) else m.join(seeds.select("entity_id").distinct(), "entity_id", "left_semi")
    pairs = asked.join(m.withColumnRenamed("entity_id", "other"), "memory_id").filter("entity_id <> other")
    return pairs.groupBy("entity_id", "other").agg(F.count(F.lit(1)).alias("shared"))


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reached from ``start`` (column node) along the edges, at any depth, itself included.

    Each round expands only what the last one reached anew; rounds are written out.
    """
    step = edges.select(F.col("source_id").alias("node"), "target_id")
    seen = frontier = saved(start.select("node").distinct(), "graph-reached")
    while True:
        reached = frontier.join(step, "node").select(F.col("target_id").alias("node")).distinct()
        frontier = saved(reached.join(seen, "node", "left_anti"), "graph-frontier")
        if frontier.isEmpty():
            return seen
        seen = saved(seen.union(frontier), "graph-reached")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, root: the least node reachable; minima spread and short-cut until nothing changes."""
    e = saved(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct(), "graph-edges")
    both = e.union(e.select("v", "u").toDF("u", "v"))
    roots = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "graph-roots")
    state = None
    while True:
        near = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        better = roots.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("root", "m").alias("root"))
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = saved(better.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "graph-roots")
        now = roots.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return roots
        state = now


def both_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """source_id, target_id, source_layer, target_layer of the edges whose ends both are vertices (id, layer)."""
    out = edges.select("source_id", "target_id")
    for end in ("source", "target"):
        out = out.join(vertices.select(F.col("id").alias(f"{end}_id"), F.col("layer").alias(f"{end}_layer")), f"{end}_id")
    return out
