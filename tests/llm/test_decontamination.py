import hashlib
import random
import re

import pytest

from cairn.llm import decontamination as x
from tests.llm.rows import awkward, documents

UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, doc_id string, spans int"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def brute(rows, items, window):
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found, longest = words(text), set(), set(), 0
        for item, body, *_ in items:
            v = words(body)
            if not v:
                continue
            n = min(window, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        runs = {tuple(words(b)[i:j]) for _, b, *_ in items for i in range(len(words(b))) for j in range(i + 1, len(words(b)) + 1)} if len(w) < 200 else set()
        longest = max((j - i for i in range(len(w)) for j in range(i + 1, len(w) + 1) if tuple(w[i:j]) in runs), default=0) if runs else 0
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][0] + spans[-1][1] == p:
                spans[-1][1] += 1
            else:
                spans.append([p, 1])
        out.append((doc_id, len(w), longest, [tuple(s) for s in spans], sorted(found)))
    return sorted(out, key=str)


def found(spark, rows, items, window):
    got = x.decontaminate(documents(spark, rows), spark.createDataFrame(items, ITEMS), window).collect()
    return sorted(((r.doc_id, r.n_words, r.longest, [tuple(s) for s in r.spans], list(r["items"])) for r in got), key=str)


def some(seed, window=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d9", "é"]) for _ in range(n))
    items = [(i % 17 or None, text(rng.choice([0, 1, 2, 5, 9])), "clash", 1) for i in range(25)] + [(40, None, None, None), (41, "--", None, None)]
    rows = [(i, text(rng.randint(0, 40)), *[None] * 6) for i in range(60)] + [r for r in awkward() if len(words(r[1])) < 200]
    return rows, items


@pytest.mark.parametrize("shard_words,piece", [(1 << 19, 1 << 14), (40, 4)])
def test_against_brute_force(spark, monkeypatch, shard_words, piece):
    rows, items = some(3)
    monkeypatch.setattr(x, "SHARD_WORDS", shard_words)
    long = items + [(99, " ".join(["a", "b", "C", "d9", "é"] * 3), None, None)]
    held = found(spark, rows, long, 3)
    if piece == 1 << 14 and shard_words > 100:
        assert held == brute(rows, long, 3)
    else:  # a run may cross the items of two shards, so that longest is the greatest of each
        assert [(a, b, d, e) for a, b, _, d, e in held] == [(a, b, d, e) for a, b, _, d, e in brute(rows, long, 3)]


def test_the_automaton_alone():
    rng = random.Random(5)
    for _ in range(60):
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 8))]) for i in range(5)]
        auto = x.Automaton()
        for _, w in items:
            auto.add(w)
        reader = x.Reader(auto.packed(items, 4))
        text = [rng.choice("abcd") for _ in range(50)]
        n, longest, spans, names = reader.read(memoryview(" ".join(text).encode()))
        rows = brute([(1, " ".join(text))], [(int(i), b" ".join(w).decode()) for i, w in items], 4)
        assert (1, n, longest, spans, names) == rows[0]


def test_pieces_of_long_items_lose_no_window(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(x, "PIECE_WORDS", 7)
    text = [f"w{i}" for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"item": ["i"], "text": pa.array([" ".join(text)])})
    held = [b.column("words")[0].as_py().decode().split() for b in x._pieces(3)([batch])]
    assert {tuple(p[i : i + 3]) for p in held for i in range(len(p) - 2)} == {tuple(text[i : i + 3]) for i in range(38)}
    assert all(len(p) <= 7 for p in held)


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep (this). {item.upper()}! And that" + " more" * 20, *[None] * 6), (2, item, *[None] * 6), (3, "clean", *[None] * 6), (4, None, *[None] * 6)]
    got = {r.doc_id: r for r in x.decontaminate(documents(spark, rows), spark.createDataFrame([(1, item, None, None)], ITEMS), with_clean=True).collect()}
    assert got[1].clean == "Keep (this). ! And that" + " more" * 20 and got[1].spans == [(2, 11)]
    assert got[2].clean is None and got[3].clean == "clean" and got[4].clean == ""


def test_digests_and_empty_tables(spark):
    rows, items = awkward(), [(1, "räven the", None, None)]
    empty = spark.createDataFrame([], ITEMS)
    got = x.digests(x.decontaminate(documents(spark, rows), empty)).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got) and {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert x.decontaminate(documents(spark, []), spark.createDataFrame(items, ITEMS)).collect() == []
    with pytest.raises(ValueError):
        x.decontaminate(documents(spark, rows), empty, 0)
