import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from cairn.llm import best_fit_packing as x
from cairn.llm.tokens import tokenizer, vocabulary_path
from tests.llm.rows import awkward, documents

ODD = ["don't I'LL 12 ab12 ŉ ﬁ İ ǅ Ω", "é é 日本 \x01\x02 a\x02b <|endoftext|> '' 'S", "\U0001f600!?! a​b \x1c x\x85y ¹²½ ª"]


def reference(text):
    return tokenizer(vocabulary_path()).whole.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer():
    rng = random.Random(4)
    parts = ["th", "er", "in", "ing", "es", "tion", "É", "ü", "A", "0", ".", ",", "!", "-", "'s"]
    texts = [r[1] for r in awkward()] + ODD + [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(50)) for _ in range(60)]
    ids, counts = tokenizer(vocabulary_path()).encode_texts(pa.array(texts))
    ends = np.cumsum(counts)
    for t, n, e in zip(texts, counts, ends, strict=True):
        assert list(ids[e - n : e]) == reference(t)


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


def test_supersteps_are_best_fit_decreasing():
    rng = random.Random(1)
    for size, n in ((10, 200), (64, 300), (4096, 300)):
        lengths = [rng.randint(1, size) if rng.random() < 0.5 else rng.randint(1, max(1, size // 5)) for _ in range(n)]
        counts = {k: lengths.count(k) for k in set(lengths)}
        runs = x.supersteps(counts, size)
        used, placed = defaultdict(list), defaultdict(set)
        for length, rank, took, first, offset in runs.tolist():
            for k in range(took):
                used[first + k].append((offset, length))
                placed[length].add(rank + k)
        assert {k: len(v) for k, v in placed.items()} == counts
        for own in used.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= size
        assert len(used) == best_fit_decreasing(lengths, size)


def check(got, rows, size):
    want = defaultdict(list)
    for r in rows:
        ids = [*reference(r[1]), 1]
        for k in range(0, len(ids), size):
            want[r[0]].append((k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())))
    have, bins = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    assert len(bins) == best_fit_decreasing([p[2] for v in want.values() for p in v], size)


def test_awkward_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK_ROWS", 3)
    rows = awkward() + [(500 + i, t, *[None] * 6) for i, t in enumerate(ODD)]
    check(x.best_fit_packing(documents(spark, rows), 100).collect(), rows, 100)
    check(x.best_fit_packing(documents(spark, rows)).collect(), rows, 4096)


def test_empty_table(spark):
    assert x.best_fit_packing(documents(spark, [])).collect() == []


def test_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK_ROWS", 2)
    rows = awkward(n=10) + [(None, t, *[None] * 6) for t in (None, "", ODD[0], ODD[0], "long " * 500)]
    check(x.best_fit_packing(documents(spark, rows), 100).collect(), rows, 100)
