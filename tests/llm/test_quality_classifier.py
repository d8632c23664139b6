import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import xxhash

from cairn.llm import quality_classifier as x
from tests.llm.rows import awkward, documents

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(["over", "under", "fish", "reef", "stone"]) + rng.choice("abcdefg") for _ in range(rng.randint(20, 90))]
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" if i % 8 == 0 else w + "***" for w in words) if bad else " ".join(words)
        rows.append((i, text, *[None] * 6))
        labels.append((i, 0 if bad else 1, 0))
    got = {r.doc_id: r for r in x.quality_classifier(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.97


def test_compiled_column_equals_the_model(spark):
    rng = np.random.default_rng(0)
    values = rng.random((500, 2))
    label = ((values[:, 0] > 0.5) & (values[:, 1] <= 0.4)).astype(float)
    model = x.fit(values, label, ["a", "b"], trees=5, steps=100)
    assert model.rules
    df = spark.createDataFrame(values.tolist(), "a double, b double")
    got = [r[0] for r in df.select(model.column()).collect()]
    logit = [model.bias + sum(w for parts, w in model.rules if all((v[{"a": 0, "b": 1}[n]] > t) == above for n, above, t in parts)) for v in values]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(logit))))
    assert ((np.array(got) > 0.5) == (label == 1)).mean() > 0.97


def test_awkward_unlabelled_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    got = x.quality_classifier(documents(spark), none).collect()
    assert len(got) == len(awkward()) and {r.score for r in got} == {0.5}
    assert x.quality_classifier(documents(spark, []), none).collect() == []


def literal(text):
    """FEATURES of one text, counted from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [ln for ln in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    many, n, chars, n_lines = (lambda s: sum(text.count(c) for c in s)), max(1, len(words)), max(1, sum(map(len, words))), max(1, len(lines))
    return {
        "words": math.log(1 + len(words)),
        "word_length": sum(map(len, words)) / n,
        "symbols": many("#*$%&|<>") / n,
        "upper": many(string.ascii_uppercase) / chars,
        "digits": many(string.digits) / chars,
        "marks": many("!?.,;:") / n,
        "bars": text.count("|") / n,
        "dup_lines": (len(lines) - len(set(lines))) / n_lines,
        "repeats": len(repeated) / n,
        "unique": len(set(words)) / n,
        "line_words": len(words) / n_lines,
    }


def corpus(n=300):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = [rng.choice(["over", "Under", "fish", "reef,", "räven", "12", "a|b", "STONE!"]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)
        text += text if i % 5 == 0 else ""
        rows.append((i, text, *[None] * 6))
        labels.append((i, int(len(words) > 25 and i % 5 != 0 or rng.random() < 0.1), 0))
    rows += [(r[0] + 1000, *r[1:]) for r in awkward()] + [(None, t, *[None] * 6) for t in (None, "", rows[1][1], rows[1][1])]
    labels += [(1, None, 0), (2, 0, 0), (2, 1, 0), (1001, 1, 0), (77_777, 1, 0), (None, 1, 0), (None, None, None)]
    return rows, labels


def test_whole_operator_against_a_literal_one(spark):
    rows, labels = corpus()
    least = {}
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            least[i] = min(q, least.get(i, q))
    order = lambda i: (int.from_bytes(xxhash.xxh64_digest(i.to_bytes(8, "little"), 42), "big", signed=True), i)
    learned = sorted((r for r in rows if r[0] in least), key=lambda r: order(r[0]))
    for most in (x.SAMPLE_ROWS, 100):
        some = learned[:most]
        model = x.fit(np.array([[literal(r[1])[k] for k in x.FEATURES] for r in some]), np.array([float(least[r[0]] == 1) for r in some]), list(x.FEATURES))
        assert model.rules
        want = []
        for r in rows:
            own = literal(r[1])
            score = 1 / (1 + math.exp(-model.bias - sum(w for parts, w in model.rules if all((own[k] > t) == above for k, above, t in parts))))
            want.append((str(r[0]), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0, round(score, 6), int(score >= 0.3)))
        got = x.quality_classifier(documents(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS), sample_rows=most).collect()
        assert sorted((str(r.doc_id), r.held_out, round(r.score, 6), r.predicted) for r in got) == sorted(want)


def test_weights_are_those_of_the_lasso():
    """At its minimum the slope of every kept rule is the penalty against the sign of its weight, and that of the bias is 0."""
    rng = np.random.default_rng(3)
    values = rng.random((600, 3))
    label = ((values[:, 0] > 0.4) ^ (rng.random(600) < 0.15)).astype(float)
    model = x.fit(values, label, ["a", "b", "c"], trees=4, penalty=0.02, steps=20_000)
    at = {n: values[:, k] for k, n in enumerate("abc")}
    holds = [np.all([(at[n] > t) == above for n, above, t in parts], axis=0).astype(float) for parts, _ in model.rules]
    p = 1 / (1 + np.exp(-model.bias - sum(h * w for h, (_, w) in zip(holds, model.rules, strict=True))))
    assert model.rules and abs((p - label).mean()) < 1e-6
    for h, (_, w) in zip(holds, model.rules, strict=True):
        slope = ((h - h.mean()) / h.std()) @ (p - label) / len(label)
        assert abs(slope + np.sign(w) * 0.02) < 1e-5
