"""Operators by hand-computed expectations, and on hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import predicates, vectors
from recollect.operators import datasets, documents, entities, graph, listing, recall, sessions, versions
from recollect.operators import vectors as search
from recollect.sources import shared


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string, relationship string, strength double")


CHAIN = [("m0", "m1", "related_to", 0.9), ("m1", "m2", "leads_to", 0.8), ("m2", "m3", "leads_to", 0.7), ("m1", "m4", "similar_to", 0.5)]


def test_k_hop_and_limit(spark):
    roots = spark.createDataFrame([("m0",), ("m3",)], "node string")
    got = {(r.root, r.node): r.depth for r in graph.k_hop(edges(spark, CHAIN), roots, 2).collect()}
    assert got == {("m0", "m0"): 0, ("m0", "m1"): 1, ("m0", "m2"): 2, ("m0", "m4"): 2, ("m3", "m3"): 0, ("m3", "m2"): 1, ("m3", "m1"): 2}
    cut = {(r.root, r.node) for r in graph.k_hop(edges(spark, CHAIN), roots, 2, limit=2).collect()}
    assert cut == {("m0", "m0"), ("m0", "m1"), ("m3", "m3"), ("m3", "m1")}
    with pytest.raises(ValueError):
        graph.k_hop(edges(spark, CHAIN), roots, 7)


def test_shortest_path_is_least_of_ties(spark):
    e = edges(spark, [("a", "c", "x", 1.0), ("a", "b", "x", 1.0), ("b", "d", "x", 1.0), ("c", "d", "x", 1.0)])
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "zz")], "source string, target string")
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {("a", "d"): (2, ["a", "b", "d"]), ("a", "a"): (0, ["a"])}


def saved_rows(monkeypatch):
    """How many rows each table that a graph operator writes has."""
    counts, write = [], graph.saved

    def counted(df, name):
        out = write(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "saved", counted)
    return counts


STAR = [(f"s{i:03}", "hub", "x", 1.0) for i in range(150)] + [("hub", "top", "x", 1.0), ("top", "hub2", "x", 1.0), ("z", "hub2", "x", 1.0), ("z2", "hub2", "x", 1.0)]


def test_limited_neighbourhoods_of_a_hub_stay_small(spark, monkeypatch):
    counts = saved_rows(monkeypatch)
    e, roots = edges(spark, STAR), spark.createDataFrame([(f"s{i:03}",) for i in range(150)], "node string")
    got = {(r.root, r.node): r.depth for r in graph.k_hop(e, roots, 2, limit=3).collect()}
    assert len(got) == 450 and [got["s149", n] for n in ("s149", "hub", "s000")] == [0, 1, 2]
    kept, among = graph.neighbourhood(e, roots, 2, limit=3)
    assert kept.filter("truncated").count() == 450
    assert {(r.source_id, r.target_id) for r in among.filter("root = 's149'").collect()} == {("s149", "hub"), ("s000", "hub")}
    assert max(counts) <= 150 * 4  # 150 x 150 were written, a row a root and neighbour


def test_whole_neighbourhoods_of_a_hub_are_not_written_a_root_each(spark, monkeypatch):
    monkeypatch.setattr(graph, "AROUND", 40)
    counts = saved_rows(monkeypatch)
    roots = spark.createDataFrame([(f"s{i:03}",) for i in range(150)] + [("top",), ("s000",), (None,), ("alone",)], "node string")
    rows = [(r.root, r.node, r.depth) for r in graph.k_hop(edges(spark, STAR), roots, 2).collect()]
    leaves = [f"s{i:03}" for i in range(150)]
    want = {(a, b): 0 if a == b else 2 for a in leaves for b in [*leaves, "top"]} | {(a, "hub"): 1 for a in leaves} | {(None, None): 0, ("alone", "alone"): 0}
    want |= {("top", b): d for d, nodes in ((0, ["top"]), (1, ["hub", "hub2"]), (2, [*leaves, "z", "z2"])) for b in nodes}
    assert len(rows) == len(want) and {(a, b): d for a, b, d in rows} == want
    assert max(counts) <= 2 * len(STAR)  # the steps themselves; 150 x 150 were written


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_whole_neighbourhoods_against_brute_force(spark, direction):
    rng = np.random.default_rng(7)
    arcs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 30, (26, 2))]
    ways = {"outgoing": arcs, "incoming": [(b, a) for a, b in arcs], "both": arcs + [(b, a) for a, b in arcs]}[direction]
    nodes = sorted({n for arc in arcs for n in arc})
    e, roots = edges(spark, [(a, b, "x", 1.0) for a, b in arcs]), spark.createDataFrame([(n,) for n in nodes], "node string")
    for depth in (1, 3):
        want = {(n, n): 0 for n in nodes}
        for d in range(1, depth + 1):
            for root, node in [k for k, v in want.items() if v == d - 1]:
                for b in {y for x, y in ways if x == node}:
                    want.setdefault((root, b), d)
        rows = graph.k_hop(e, roots, depth, direction).collect()
        assert len(rows) == len(want) and {(r.root, r.node): r.depth for r in rows} == want


def test_reached_nodes_are_written_once(spark, monkeypatch):
    counts = saved_rows(monkeypatch)
    roots = spark.createDataFrame([(f"s{i:03}",) for i in range(150)], "node string")
    assert {r.node for r in graph.within_hops(edges(spark, STAR), roots, 2).collect()} == {"hub", "top"} | {f"s{i:03}" for i in range(150)}
    assert max(counts) <= 150


def test_paths_between_leaves_of_hubs_stay_small(spark, monkeypatch):
    counts = saved_rows(monkeypatch)
    pairs = spark.createDataFrame([(f"s{i:03}", "z") for i in range(150)] + [("s000", "s001"), ("s000", "hub"), ("hub", "z2"), ("top", "top")], "source string, target string")
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.shortest_paths(edges(spark, STAR), pairs, 4).collect()}
    assert len(got) == 154 and got["s007", "z"] == (4, ["s007", "hub", "top", "hub2", "z"])
    assert [got[p][0] for p in (("s000", "s001"), ("s000", "hub"), ("hub", "z2"), ("top", "top"))] == [2, 1, 3, 0]
    assert max(counts) <= 320  # the steps themselves; 150 x 150 were written
    assert ("s007", "z") not in {(r.source, r.target) for r in graph.shortest_paths(edges(spark, STAR), pairs, 3).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_neighbourhoods_and_paths_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    arcs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 24, (24, 2))]
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted({n for arc in arcs for n in arc})
    e, roots = edges(spark, [(a, b, "x", 1.0) for a, b in arcs]), spark.createDataFrame([(n,) for n in nodes], "node string")
    paths, level = {(n, n): [n] for n in nodes}, {(n, n): [n] for n in nodes}
    for _ in range(4):
        longer = {}
        for (a, b), path in level.items():
            for c in near[b]:
                if (a, c) not in paths:
                    longer[a, c] = min(longer.get((a, c), [*path, c]), [*path, c])
        paths |= longer
        level = longer
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "source string, target string")
    assert {(r.source, r.target): r.path for r in graph.shortest_paths(e, pairs, 4).collect()} == paths
    for limit in (2, 5):
        around = {a: [a, *sorted(b for x, b in paths if x == a and b != a and len(paths[x, b]) <= 4)] for a in nodes}
        want = {(a, b): len(paths[a, b]) - 1 for a in nodes for b in around[a][:limit]}
        assert {(r.root, r.node): r.depth for r in graph.k_hop(e, roots, 3, limit=limit).collect()} == want
        kept, among = graph.neighbourhood(e, roots, 3, limit=limit)
        assert {(r.root, r.node): r.truncated for r in kept.collect()} == {(a, b): len(around[a]) > limit for a, b in want}
        assert sorted(tuple(r)[:3] for r in among.select("root", "source_id", "target_id").collect()) == sorted((n, a, b) for n in nodes for a, b in arcs if (n, a) in want and (n, b) in want)


def test_traversal_keeps_paths_apart_and_ends_on_cycles(spark):
    e = edges(spark, [("a", "b", "x", 0.1), ("b", "a", "x", 0.2), ("b", "c", "x", 0.3)])
    rows = graph.traversal(e, spark.createDataFrame([("a",)], "node string"), 5).collect()
    assert sorted((r.node, r.depth, r.total_strength) for r in rows) == [("b", 1, 0.1), ("c", 2, 0.3)]


def test_components_and_descendants(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(100, 101)], "src long, dst long")
    roots = {r.node: r.root for r in graph.components(e).collect()}
    assert {roots[i] for i in range(26)} == {0} and roots[101] == 100
    down = edges(spark, CHAIN)
    assert sorted(r.node for r in graph.descendants(down, spark.createDataFrame([("m1",)], "node string")).collect()) == ["m1", "m2", "m3", "m4"]


def test_last_write_wins_in_simple_graph(spark):
    e = edges(spark, [("a", "b", "x", 0.1), ("b", "a", "a", 0.2), ("a", "a", "x", 1.0)])
    assert [tuple(r) for r in graph.simple_graph(e).collect()] == [("a", "b", "a", 0.2)]


def test_simple_graph_takes_more_tasks_for_more_edges(spark, monkeypatch):
    """One shuffle, of as many partitions as the edges need; of one relation the greatest strength."""
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    e = edges(spark, [(f"p{i % 40}", f"s{i % 40}", "xy"[i % 80 // 40], i / 200) for i in range(200)])
    found = graph.simple_graph(e)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(a#" in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"p{i}", f"s{i}", "y", (i + 120) / 200) for i in range(40))


def test_search_against_brute_force_and_blocks(spark):
    rng = np.random.default_rng(42)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = v.filter("id % 20 = 0 and embedding is not null")
    got = {(r.query_id, r["rank"]): r.id for r in search.search(v, asked, 5, block=2).collect()}
    m = {i: np.array(x, np.float32).astype(float) for i, x in rows if x is not None}
    for q in (0, 20, 40, 60):
        sims = sorted((-round(float(m[q] @ m[i] / (np.linalg.norm(m[q]) * np.linalg.norm(m[i]) or 1)), 6), i) for i in m if i != q)
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in sims[:5]]
    near = search.within(v, asked, 0.3, block=1).count()
    assert near == sum(1 for q in (0, 20, 40, 60) for i in m if i != q and round(float(m[q] @ m[i] / (np.linalg.norm(m[q]) * np.linalg.norm(m[i]) or 1)), 6) >= 0.3)


def test_recall_of_inverted_lists(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.filter("id % 20 = 0")
    exact = {(r.query_id, r.id) for r in search.search(v, asked, 10).collect()}
    found = {(r.query_id, r.id) for r in search.InvertedLists(v).search(asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_inverted_lists_multiply_blocks_and_skip_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, None)] + [(201 + i, [1.0] * 8) for i in range(30)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = v.filter("id % 20 = 0")
    exact = [tuple(r) for r in search.search(v, asked, 7).orderBy("query_id", "rank").collect()]
    found = search.InvertedLists(v, lists=4).search(asked, 7, probes=4)  # all lists: exact
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == exact
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_ties_and_of_what_does_not_count(k):
    rng = np.random.default_rng(1)
    ids, sims = rng.permutation(40), rng.integers(0, 5, (6, 40)).astype(float)
    sims[sims == 4] = -np.inf
    which, row = search._best(ids, sims, k)
    want = [(q, i) for q in range(6) for i in sorted((j for j in range(40) if sims[q, j] > -np.inf), key=lambda j: (-sims[q, j], ids[j]))[:k]]
    assert list(zip(which.tolist(), row.tolist(), strict=True)) == want


def test_cosine_of_zero_and_of_other_lengths(spark):
    one = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert one.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    with pytest.raises(Exception, match="different lengths"):
        one.select(vectors.cosine(F.col("b"), F.array(F.lit(1.0)))).collect()


def test_slice_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, name string")
    assert datasets.slice_rows(df, filters=[("k", ">", 0)], order_by="name").collect()[0].total == 2
    for bad in ({"columns": ["zz"]}, {"filters": [("k", "~", 1)]}, {"filters": [("k", "in", 1)]}, {"limit": 0}):
        with pytest.raises(ValueError):
            datasets.slice_rows(df, **bad)
    with pytest.raises(ValueError):
        datasets.slice_sql(df, "DROP TABLE data")


def test_slice_sql_reads_only_its_view(spark, small):
    df = spark.read.parquet(f"{small}/nation.parquet")
    assert datasets.slice_sql(df, "select count(*) n from data where n_name <> 'update'").first().n == 25
    with pytest.raises(ValueError):
        datasets.slice_sql(df, f"select * from parquet.`{small}/region.parquet`")


def test_quantiles_against_sorting(spark):
    values = [3.0, 1.0, None, 1.0, 1.0, 99.0, 2.5, 7.0]
    df = spark.createDataFrame([(v, 5.0) for v in values], "v double, same double")
    got = {(r["column"], r.q): r["value"] for r in datasets.quantiles(df, ["v", "same"], [0.0, 0.25, 0.5, 1.0]).collect()}
    s = sorted(v for v in values if v is not None)
    assert {q: got["v", q] for q in (0.0, 0.25, 0.5, 1.0)} == {q: s[int((len(s) - 1) * q + 0.5)] for q in (0.0, 0.25, 0.5, 1.0)}
    assert got["same", 0.5] == 5.0


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert datasets.quantiles(df, ["v"], [0.5]).collect() == [] and datasets.histogram(df, "v").collect() == []
    assert datasets.top_values(df, ["s"]).collect() == []


def test_hydration_keeps_or_drops_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key long, v string")
    asked = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 9)], "pos long, id long")
    assert sorted(r.pos for r in listing.hydrate(rows, "key", asked).collect()) == [0, 1, 2]
    assert sorted(r.pos for r in listing.hydrate_once(rows, "key", asked).collect()) == [0, 1]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank long")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, rank long")
    assert [r.id for r in recall.fuse([a, b], 5).orderBy("rank").collect()] == [11, 10]


def test_fold_and_heads(spark):
    log = spark.createDataFrame([(1, 1, "update"), (1, 2, "create"), (1, 3, "create"), (1, 4, "update"), (1, 5, "delete"), (1, 6, "update")], "resource_id long, sequence long, op string")
    kept = versions.fold(log)
    assert [(r.sequence, r.revision) for r in kept.orderBy("sequence").collect()] == [(2, 1), (4, 2), (5, 3)]
    assert versions.heads(kept, "resource_id", "revision").first().op == "delete"


def test_evict_oldest_first(spark):
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "key string, size long, mtime long")
    assert [r.key for r in documents.evict(files, 10).collect()] == ["a"]
    assert documents.evict(files, 0).count() == 3 and documents.evict(files, 15).count() == 0


def test_superseded_and_crossings(spark):
    c = spark.createDataFrame([(1, 2, 2, False), (3, 4, 3, True)], "a long, b long, newer long, resolved boolean")
    assert [r.id for r in entities.superseded(c).collect()] == [1]
    n = spark.createDataFrame([("x", 0, 1), ("y", 1, 4), ("z", 8, 31)], "key string, old long, new long")
    assert sorted(r.key for r in sessions.crossings(n).collect()) == ["x", "z"]


def test_tags_and_json(spark):
    df = spark.createDataFrame([(["a", "b"], '{"k": 7}')], "tags array<string>, j string")
    assert df.select(predicates.tags_all(F.col("tags"), ["a", "b"]), predicates.tags_any(F.col("tags"), ["z"]), predicates.json_contains(F.col("j"), {"k": "7"})).first() == (True, False, True)


def test_formats(spark, tmp_path):
    from recollect.sources import formats

    with pytest.raises(ValueError):
        formats.format_of("x.exe")
    df = spark.createDataFrame([(1, 'a "quoted", one'), (2, None)], "k long, v string")
    for end in ("csv", "tsv", "ndjson", "parquet"):
        formats.write(df, f"{tmp_path}/t.{end}")
        assert sorted(formats.read(spark, f"{tmp_path}/t.{end}", "k long, v string").collect()) == sorted(df.collect())
    polled = formats.poll_files(spark, str(tmp_path), "*.parquet")
    assert polled.count() > 0 and {r.content_type for r in polled.collect()} == {"parquet"}
    assert formats.new_files(polled, polled).count() == 0 and formats.new_files(polled, polled, full=True).count() == polled.count()


@pytest.mark.parametrize("statement", [
    "WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '/tmp/slice-out' USING parquet SELECT * FROM x", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.System', 'getProperty', 'user.dir') FROM data",
    "SELECT * FROM hidden", "SELECT a FROM data WHERE a IN (SELECT a FROM hidden)", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x", "SELECT * FROM data; SELECT 1", "DROP VIEW data", "SELECT * FROM range(10)", "SELECT * FROM parquet.`/tmp/x`",
    "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "SELECT max(a) FROM hidden WHERE 'CTE [hidden]' <> ''", "SELECT 'x' AS `CTE [hidden]`, a FROM hidden", "SELECT a FROM data WHERE EXISTS (SELECT 1 FROM hidden h WHERE h.a = data.a)",
    "SELECT (SELECT max(a) FROM hidden) AS m FROM data", "WITH data AS (SELECT * FROM hidden) SELECT * FROM data", "SELECT * FROM data) SELECT * FROM hidden --", "EXPLAIN SELECT * FROM data", "SELECT TRANSFORM(a) USING 'cat' FROM data", "SELECT * FROM global_temp.hidden", "TABLE hidden",
    "SELECT * FROM data UNION ALL SELECT * FROM hidden", "SELECT * FROM data, LATERAL (SELECT * FROM hidden) x", "SELECT array(1, (SELECT max(a) FROM hidden)) AS m FROM data GROUP BY a HAVING a IN (SELECT a FROM hidden)",
])
def test_slice_refuses_before_anything_runs(spark, statement):
    spark.range(3).toDF("a").createOrReplaceTempView("hidden")
    with pytest.raises(ValueError):
        datasets.slice_sql(spark.range(5).toDF("a"), statement)
    spark.catalog.dropTempView("hidden")


@pytest.mark.parametrize(("statement", "n"), [
    ("SELECT a FROM data WHERE 'a;b' <> 'c' AND 'hidden' = 'hidden'", 5), ("SELECT a FROM data;  ", 5), ("SELECT * FROM data TABLESAMPLE (100 PERCENT)", 5), ("SELECT a, x FROM data LATERAL VIEW explode(array(1, 2)) t AS x", 10), ("WITH x AS (SELECT a FROM data), y AS (SELECT a FROM x WHERE a > 1) SELECT * FROM y JOIN x USING (a)", 3),
    ("SELECT * FROM data WHERE a IN (SELECT max(a) FROM data)", 1), ("SELECT a, count(*) OVER () AS n FROM data", 5), ("SELECT * FROM VALUES (1), (2) AS v(a) JOIN data USING (a)", 2), ("SELECT a FROM data EXCEPT SELECT 1", 4), ("select upper('insert') as u from data", 5), ("SELECT to_json(struct(a)) AS j, encode(string(a), 'utf-8') AS e, regexp_count(string(a), '1') AS n FROM data", 5),
])
def test_slice_allows_every_query_of_its_data(spark, statement, n):
    spark.range(3).toDF("a").createOrReplaceTempView("hidden")
    assert datasets.slice_sql(spark.range(5).toDF("a"), statement).count() == n
    spark.catalog.dropTempView("hidden")


def test_csv_lines_and_summaries(spark):
    df = spark.createDataFrame([(1, None, "a,b"), (2, 'say "hi"', None), (3, "", "x\ny")], "k int, a string, b string")
    assert [r.line for r in df.select(datasets.csv_line(["k", "a", "b"]).alias("line")).orderBy("line").collect()] == ['1,,"a,b"', '2,"say ""hi""",', '3,,"x\ny"']
    found = {r["column"]: r.summary for r in datasets.summaries(df.selectExpr("k", "a", "k > 1 as flag", "cast(null as double) as none", "if(k < 3, k / 10, null) as share"), "t").collect()}
    assert found["share"].startswith("In dataset 't', column 'share' (float type): Contains 1 null values (33.3% of rows). Has 3 unique values. Range: 0.10 to 0.20. Mean: 0.15")
    assert "flag" not in found and found["none"].endswith("Has 1 unique values.") and "String lengths: min=0, max=8" in found["a"]


def test_slices_of_two_callers_dont_meet(spark):
    one, two = (spark.range(n).toDF("a") for n in (3, 5))
    first = datasets.slice_sql(one, "SELECT count(*) AS n, max(a) AS m FROM data")
    second = datasets.slice_sql(two, "WITH x AS (SELECT a FROM data WHERE a > (SELECT min(a) FROM data)) SELECT count(*) AS n, max(a) AS m FROM x")
    assert tuple(first.first()) == (3, 2) and tuple(second.first()) == (4, 4)
    assert not any(t.name.startswith("slice_") for t in spark.catalog.listTables())


def test_identifiers():
    assert [datasets.identifier(n) for n in ("a_1", "1a", "a b-c.d")] == ["`a_1`", "`1a`", "`a b-c.d`"]
    for bad in ("a`", "", "a;b", 'a"', "a'b"):
        with pytest.raises(ValueError):
            datasets.identifier(bad)


def test_near_links_connect_what_all_pairs_do(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    for block in (2048, 7):
        links = search.near_links(v, 0.9, block=block)
        assert links.count() < 60 * 60 // 4
        sizes = graph.components(links).groupBy("root").count().collect()
        assert sorted(r["count"] for r in sizes) == [10] * 6


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),), (None,)], "v double")
    assert sum(r.n for r in datasets.histogram(df, "v", 5).collect()) == 10


def test_comention_takes_more_tasks_for_more_members(spark, small, monkeypatch):
    """The steps by memory keep to one partitioning, of as many partitions as the members need; seeds are rows or a condition."""
    from recollect.plans import all as plans

    m = spark.createDataFrame([(e, k) for k in range(30) for e in range(k % 5, k % 5 + 4)], "entity_id long, memory_id long")
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    found = graph.comention(m, F.col("entity_id") % 3 == 0, m.count())
    by_rows = graph.comention(m, m.filter("entity_id % 3 = 0"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_rows.collect())) != []
    tasks = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 10)
    for name in ("g9_entity_neighbourhood", "g10_comention", "e13_related"):
        plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan, name
