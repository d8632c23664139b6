import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from cairn.llm import ngram_join as x
from cairn.llm import words
from tests.llm.rows import awkward, documents


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted((r[0], len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows))


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 30))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        base = texts[rng.randrange(len(texts))].split() if texts and kind < 0.6 else [word() for _ in range(rng.choice([3, 6, 8, 9, 10, 12, 14, 20, 40, 80, 200]))]
        if kind < 0.6:
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base = base[: max(1, len(base) - rng.randint(1, 3))]
            if rng.random() < 0.2:
                base[0] = base[0].upper()
        elif kind < 0.8:
            base = passage + base
        texts.append(" ".join(base))
    return [(i, t, *[None] * 6) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(x, "HEAVY_COUNT", 2 + seed)
    monkeypatch.setattr(x, "PAIRS_PER_ENTRY", 0.2 * seed)
    monkeypatch.setattr(x, "CROWD", 2)
    rows = corpus(seed) + [(r[0] + 1000, *r[1:]) for r in awkward()]
    got = x.ngram_join(documents(spark, rows).repartition(3)).drop("class_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(x, "REMEMBERED", 2)  # sets take over one another's slots
    rows = corpus(3, 40)
    rows += [(None, t, *[None] * 6) for t in (None, "", rows[0][1], rows[0][1], rows[39][1] + " more", "alone here", "alone here")]
    ids = [(i if r[0] is None else r[0], *r[1:]) for i, r in enumerate(rows, 1000)]
    want = [(None if i >= 1000 else i, n, None if c >= 1000 else c) for i, n, c in brute(ids)]
    got = x.ngram_join(documents(spark, rows).repartition(3)).drop("class_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_overlap_is_exact():
    for s in range(1, 60):
        assert set(x.partners(s)) == {t for t in range(1, 90) if 5 * min(s, t) >= 4 * max(s, t)}
        for t in x.partners(s):
            c = x.overlap(s, t)
            assert 100 * c >= 80 * (s + t - c) and 100 * (c - 1) < 80 * (s + t - c + 1)


def test_boundary_follows_cost():
    assert x.choose_boundary({5: 100}) >= 5
    assert x.choose_boundary({20: 100}) < 16
    assert x.choose_boundary({}) == 0


def test_empty_table(spark):
    assert x.ngram_join(documents(spark, [])).collect() == []


def test_word_hashes_wherever_words_stand(monkeypatch):
    rng = random.Random(6)
    letters = "abcABCéß\U0001f600,.|\x1c\x85 \t\n\x0b\x0c\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["x" * 5000 + " Y" + "y" * 40, "", "  ", "ab\n", " ab"]
    want, seen = [], {}
    for t in texts:
        want.append(re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), t.encode())))
    for step, block in ((1 << 18, 1 << 18), (500, 1 << 18), (10, 64), (1 << 18, 50)):
        monkeypatch.setattr(words, "STEP_BYTES", step)
        monkeypatch.setattr(words, "BLOCK", block)
        monkeypatch.setattr(words, "_POWERS", [])
        got = []
        for raw, ends in words.slices(pa.array(texts)):
            hashes, edge = words.word_hashes(raw, ends)
            got += [hashes[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)]
        assert list(map(len, got)) == list(map(len, want))
        for hs, ws in zip(got, want, strict=True):
            for h, w in zip(hs, ws, strict=True):
                assert block != 1 << 18 or seen.setdefault(w, h) == h
        if block == 1 << 18:
            assert len(set(seen.values())) == len(seen)
        else:  # other powers, other hashes: equal words still have equal ones, others not
            pairs = {(w, h) for hs, ws in zip(got, want, strict=True) for h, w in zip(hs, ws, strict=True)}
            assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_grams_are_counted_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(x, "BUCKET_ENTRIES", 3)
    rng = random.Random(2)
    rows = [(i, sorted({rng.randint(-(2**63), 2**63 - 1) if rng.random() < 0.5 else rng.randint(-5, 5) for _ in range(8)})) for i in range(50)]
    count = defaultdict(int)
    for _, grams in rows:
        for g in grams:
            count[g] += 1
    got = {r.gram: r.k for r in x.shared_grams(spark, x.Lists(spark.createDataFrame([(i, 8, 0, g) for i, g in rows], "cls long, n int, prio int, grams array<long>").repartition(5)), 400).collect()}
    assert got == {g: k for g, k in count.items() if k > 1}
