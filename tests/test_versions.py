"""The mutation contract against a writer that takes one operation after the other."""

import hashlib
import random

import pytest

from recollect.operators import versions
from recollect.operators.versions import MUTATION

SCHEMA = "resource_id long, sequence long, operation_id string, request_hash string, action string, expected string, content string, logical_key string, owner string"


def tag(revision, content):
    return f"vr-{revision}-{hashlib.sha256(content.encode()).hexdigest()[:16]}"


def one_by_one(log):
    heads, ids, out = {}, {}, []
    for r, s, op, request, action, expected, content, key, owner in sorted(log, key=lambda x: (x[0], x[1])):
        head = heads.get(r)
        if op is not None and (r, op) in ids:
            known, revision, etag = ids[r, op]
            out.append((r, s, "replayed", revision, etag) if known == request else (r, s, "conflict", None, None))
            continue
        if action not in ("create", "replace", "delete", "restore"):
            why = "invalid"
        elif action == "create":
            why = "precondition" if expected != "*" else "conflict" if head else None
        elif not head:
            why = "not_found"
        elif expected != head["etag"]:
            why = "precondition"
        elif action == "restore" and not head["deleted"]:
            why = "conflict"
        elif action != "restore" and head["deleted"]:
            why = "not_found"
        else:
            why = "conflict" if (key, owner) != (head["key"], head["owner"]) else None
        if why:
            out.append((r, s, why, None, None))
            continue
        revision = head["revision"] + 1 if head else 1
        heads[r] = {"revision": revision, "etag": tag(revision, content), "deleted": action == "delete", "key": key, "owner": owner}
        if op is not None:
            ids[r, op] = (request, revision, tag(revision, content))
        out.append((r, s, "accepted", revision, tag(revision, content)))
    return sorted(out)


def noise(seed, n=400, resources=4):
    """Writers that mostly know the head, contents of which there are two, ids that come again in other requests."""
    near, log, heads = random.Random(seed), [], {}
    for s in range(n):
        r = near.randrange(resources)
        revision, content, deleted = heads.get(r, (0, "", False))
        action = near.choice(["replace"] * 5 + ["delete", "restore", "create", "odd"]) if revision else near.choice(["create", "create", "replace"])
        action = "restore" if deleted and near.random() < 0.8 else action
        expected = "*" if action == "create" and near.random() < 0.9 else tag(max(0, revision - (near.random() < 0.15)), content) if revision else None
        new = near.choice("ab")
        row = (r, s, near.choice([f"o{near.randrange(n // 2)}", f"n{s}", None]), near.choice("hg"), action, expected, new, near.choice(["k"] * 15 + ["l"]), near.choice(["u"] * 15 + [None]))
        log.append(row)
        done = {(x[0], x[1]): x for x in one_by_one(log)}[r, s]
        if done[2] == "accepted":
            heads[r] = (done[3], new, action == "delete")
    return log


@pytest.mark.parametrize("seed", range(3))
def test_every_answer(spark, seed):
    log = noise(seed)
    found = versions.mutate(spark.createDataFrame(log, SCHEMA).repartition(3))
    expected = one_by_one(log)
    assert sorted(tuple(r) for r in found.select("resource_id", "sequence", "outcome", "revision", "etag").collect()) == expected
    assert {x[2] for x in expected} >= {"accepted", "replayed", "conflict", "precondition"}


def test_a_refused_mutation_leaves_its_id_free(spark):
    log = [
        (1, 1, "k", "h", "replace", "vr-1-x", "a", "key", "me"),
        (1, 2, "c", "h", "create", "*", "a", "key", "me"),
        (1, 3, "k", "h", "replace", tag(1, "a"), "b", "key", "me"),
        (1, 4, "k", "h", "replace", tag(1, "a"), "b", "key", "me"),
        (1, 5, "k", "other", "replace", tag(2, "b"), "c", "key", "me"),
    ]
    found = versions.mutate(spark.createDataFrame(log, SCHEMA)).orderBy("sequence").collect()
    assert [(r.outcome, r.revision) for r in found] == [("not_found", None), ("accepted", 1), ("accepted", 2), ("replayed", 2), ("conflict", None)]
    assert found[3].etag == found[2].etag
    kept = versions.snapshots(spark.createDataFrame(log, SCHEMA)).orderBy("revision").collect()
    assert [(r.revision, r.content) for r in kept] == [(1, "a"), (2, "b")]


def test_evidence_of_what_was_replaced(spark):
    log = spark.createDataFrame([(1, 1, "a", "h", "create", "*", "a", "k", "me"), (1, 2, "b", "h", "replace", tag(1, "a"), "b", "k", "me"), (2, 1, "c", "h", "create", "*", "a", "k", "me")], SCHEMA)
    found = versions.without_evidence(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "resource_id long, note string"), log)
    assert {r.resource_id: r.active for r in found.collect()} == {1: False, 2: True, 3: True}


def test_one_resources_log_is_many_tasks_work(spark):
    """A chain of 3,000 revisions of one resource: its windows are cut by ETag, its heads by range."""
    log, content = [(7, 0, "o0", "h", "create", "*", "c0", "k", "me")], "c0"
    for s in range(1, 3000):
        log.append((7, s, f"o{s}", "h", "replace", tag(s, content), f"c{s}", "k", "me"))
        content = f"c{s}"
    found = versions.mutate(spark.createDataFrame(log, SCHEMA))
    assert found.filter("outcome = 'accepted' and revision = sequence + 1").count() == 3000
    cut = versions.last_before(spark.range(1000).selectExpr("1 as k", "id as s", "if(id % 7 = 0, id, null) as v"), "k", "s", versions.F.col("v"), "before")
    assert {(r.s, r.before) for r in cut.collect()} == {(s, (s - 1) // 7 * 7 if s else None) for s in range(1000)}


def test_nothing(spark):
    assert versions.mutate(spark.createDataFrame([], SCHEMA)).collect() == []
    assert list(MUTATION) == SCHEMA.replace(" string", "").replace(" long", "").split(", ")[2:]


def test_a_log_is_shuffled_few_times(spark, small, monkeypatch):
    """The writers' log is one shuffle, and of the log's own joins and windows none is done twice."""
    from recollect.plans import all as plans

    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    planned, save = [], versions.saved
    monkeypatch.setattr(versions, "saved", lambda df, name: planned.append((name, shuffles(df))) or save(df, name))
    found = plans.QUERIES["m4_skill_mutations"](spark, small)
    steps = [n for name, n in planned if name in ("versions-log", "versions-done", "versions-ranges")] + [shuffles(found)]
    assert dict(planned)["versions-log"] == 1
    assert sum(steps) == 7  # the log 1, its rows by id 1, by range 1; within ranges, and the ends of ranges 3, broadcast
