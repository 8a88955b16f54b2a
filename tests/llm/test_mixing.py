import re
from collections import defaultdict

from hard_rows import ROWS

from recollect.llm import mixing


def by_hand(rows, share=1.5, epochs=2, weights=(3, 1, 2)):
    """Targets by repeated resharing of the excess."""
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(size.values()), set()
    while True:
        left = budget - sum(epochs * size[s] for s in full)
        total = sum(w[s] for s in size if s not in full)
        target = {s: epochs * size[s] if s in full else left * w[s] / total for s in size}
        over = {s for s in size if target[s] > epochs * size[s]}
        if not over:
            return size, target
        full |= over


def test_targets_taken_and_limits(spark, hard):
    size, target = by_hand(ROWS)
    rows = mixing.mix(hard).collect()
    assert len(rows) == len(ROWS)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - target[s]) <= 1


def test_reruns_agree_and_budget_cuts(spark, hard):
    first = sorted(map(str, mixing.mix(hard).collect()))
    assert first == sorted(map(str, mixing.mix(hard.repartition(7)).collect()))
    cut = mixing.mix(hard, budget=100).collect()
    assert sum(r.taken for r in cut) == 100


def test_empty(nothing):
    assert mixing.mix(nothing).collect() == []
