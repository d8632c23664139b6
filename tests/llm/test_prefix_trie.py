import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cairn.llm import prefix_trie as x

SCHEMA = "conv_id long, turn long, role string, text string, k long, depth int, owner string"


def key(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()


def brute(rows, rebuilt=True):
    """Every node by its whole sequence of turns."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    if rebuilt:
        base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
        own = {c: own.get(base(c), [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out = {}
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(out[c][5] for c in children[n]) or 1
        saved = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(out[c][6] for c in children[n])
        ends = ",".join(str(c) for c in sorted(c for c in members[n] if len(own[c]) == len(n)))
        out[n] = (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(spark, rows, rebuilt=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, x.prefix_trie(df, x.with_shared_starts if rebuilt else None).collect()), key=str)


def some(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 90), n):
        for turn in range(rng.choice([1, 2, 4, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(["a", "é\U0001f600", "", None]) if turn % 3 else "same", 1, 2, "x"))
    rows += rows[:5] + [(None, 0, "user", "lost", 1, 2, "x"), (1000, 0, None, None, 1, 2, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,chunk", [(1, 4096, 1 << 16), (2, 3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(x, "BLOCK", block)
    monkeypatch.setattr(x, "CHUNK_BYTES", chunk)
    rows = some(seed)
    assert found(spark, rows) == brute(rows)


def test_snapshots_of_one_conversation(spark):
    """Each conversation goes on from the one before: as many chains on one another as there are."""
    rows = [(100 + c, t, "user", f"t{t}", 1, 2, "x") for c in range(12) for t in range(c + 1)]
    rows += [(200 + c, t, "user", f"t{t}", 1, 2, "x") for c in range(6) for t in range(12)]
    rows += [(50, t, "user", f"t{t}" if t < 5 else "own", 1, 2, "x") for t in range(8)]
    assert found(spark, rows, False) == brute(rows, False)


def test_one_turn_and_none(spark):
    assert found(spark, []) == []
    rows = [(7, None, None, None, 1, 2, "x")]
    assert found(spark, rows, False) == brute(rows, False)
    assert found(spark, rows) == brute(rows)
