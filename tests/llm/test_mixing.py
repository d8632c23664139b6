import re
from collections import defaultdict

import pytest

from cairn.llm import mixing
from tests.llm.rows import awkward, documents


def test_targets_and_taken(spark):
    rows = awkward()
    got = [r.asDict() for r in mixing.mix(documents(spark)).collect()]
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_reruns_agree_and_empty(spark):
    a, b = (sorted(map(str, mixing.mix(documents(spark).repartition(k)).collect())) for k in (2, 7))
    assert a == b
    assert mixing.mix(documents(spark, [])).collect() == []


def test_rows_without_an_id(spark):
    rows = awkward(n=10) + [(None, t, "en", s, *[None] * 4) for t in (None, "", "a b c", "a b c", "d " * 500) for s in ("a", None)]
    runs = [mixing.mix(documents(spark, rows).repartition(k)).collect() for k in (1, 5)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    assert sorted((str(r.doc_id), r.size) for r in runs[0]) == sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in runs[0]:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
