import random
import zlib

import numpy as np
import pandas as pd

from cairn.llm import language_id as x
from tests.llm.rows import awkward, documents

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ver", "zig"], "cc": ["çé", "eau", "oi", "ré"]}


def made(n=600):
    rng = random.Random(5)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        out.append((i, text, lang, None, None, 1, 2, 3))
    return out


def test_held_out_accuracy_and_unknown(spark):
    rows = made() + [(10_000, None, "aa", *[None] * 5), (10_001, "12 !?", "bb", *[None] * 5), (10_002, "", None, *[None] * 5)]
    got = {r.doc_id: r for r in x.language_id(documents(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 10_000]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.98
    for k in (10_000, 10_001, 10_002):
        assert got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[r[0]].rejected for r in held)


def test_model_sums_to_one():
    rng = np.random.default_rng(1)
    letters = np.array([0, 97, 98, 99, 100])
    keys = letters[rng.integers(0, 5, 3000)] << 42 | letters[rng.integers(0, 5, 3000)] << 21 | letters[rng.integers(0, 5, 3000)]
    found, n = np.unique(keys, return_counts=True)
    m = x.fit_model("t", found, n)
    for u, v in ((97, 98), (0, 0), (500, 97)):
        p = np.exp(m.log_probability(np.array([u << 42 | v << 21 | w for w in letters])))
        rest = 1000 * np.exp(m.unseen)
        assert p.sum() <= 1 + 1e-9 and p.sum() > 0.9 - rest


def test_pieces_give_the_same_trigrams(monkeypatch):
    texts = [r[1] for r in awkward()][:70] + ["räven über " * 50]
    count = lambda: sorted((int(k), int(r)) for keys, rows in x.trigrams(texts) for k, r in zip(keys, rows, strict=True))
    whole = count()
    monkeypatch.setattr(x, "PIECE", 7)
    assert count() == whole


def test_dense_and_sorted_distinct_agree():
    keys = np.concatenate([k for k, _ in x.trigrams(["abc déf", "zz y"] * 5)])
    a, b = x._distinct(keys), np.unique(keys, return_inverse=True)
    assert (np.asarray(a[0])[a[1]] == keys).all() and (a[0] == b[0]).all()


def test_awkward_and_empty(spark):
    assert len(x.language_id(documents(spark)).collect()) == len(awkward())
    assert x.language_id(documents(spark, [])).collect() == []


def test_random_letters_are_rejected_at_every_size(spark):
    rng = random.Random(9)
    noise = lambda letters: " ".join("".join(rng.choice("bdfgjkpqvwxyz") for _ in range(6)) for _ in range(letters // 6))
    foreign = "ἄνδρα μοι ἔννεπε μοῦσα πολύτροπον ὃς μάλα πολλὰ πλάγχθη"
    strange = [(50_000 + i, t, None, *[None] * 5) for i, t in enumerate([noise(60), noise(300), noise(30_000), foreign, foreign * 200])]
    for n in (120, 600, 6000):
        rows = made(n)
        got = {r.doc_id: r for r in x.language_id(documents(spark, rows + strange)).collect()}
        assert all(got[r[0]].rejected for r in strange), n
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
        assert sum(got[r[0]].rejected for r in held) <= 0.005 * len(held), n


def test_a_rare_language_has_limits_of_its_own():
    bins = pd.DataFrame([("aa", k, 200 + i, 30) for k in (5, 6) for i in range(20)] + [("bb", 5, 400, 3)], columns=["lang_pred", "size_class", "bin", "n"])
    got = {(m, k): limit for m, k, limit in x.calibrated(bins, ["aa", "bb", "cc"])}
    assert len(got) == 3 * 13
    assert 2.2 < got["aa", 5] < 3 and 2.2 < got["aa", 12] < 3 and got["aa", 0] > got["aa", 5]
    assert 4.01 < got["bb", 5] < 5 and 4.01 < got["cc", 12] < 5


def test_more_trigrams_than_are_sent_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(x, "PIECE", 50)
    rows = made(300) + [(10_000, None, "aa", *[None] * 5), (10_001, "12 !?", "bb", *[None] * 5), (10_002, "漢字かな交じり文 zzz ka", None, *[None] * 5)]
    docs = documents(spark, rows + rows[:1])
    whole, cut_off = (sorted(map(tuple, x.language_id(docs, most=most).collect())) for most in (x.MODEL_NGRAMS, 20))
    assert len(whole) == len(rows) + 1
    for a, b in zip(whole, cut_off, strict=True):
        assert (a[0], a[1], a[3], a[5]) == (b[0], b[1], b[3], b[5])
        assert np.allclose([a[2], a[4]], [b[2], b[4]])


def brute_probability(counts):
    """Interpolated Kneser-Ney from the definition, with dicts."""
    from collections import defaultdict

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    pair = defaultdict(int)
    for a, b, c in counts:
        pair[b, c] += 1
    uni = defaultdict(int)
    for _, c in pair:
        uni[c] += 1
    d3, d2, d1 = (discount(list(v.values())) for v in (counts, pair, uni))
    whole = sum(uni.values())
    floor = d1 * len(uni) / whole / (len(uni) + 1000)

    def p1(c):
        return max(uni[c] - d1, 0) / whole + floor if c in uni else floor

    def p2(b, c):
        ends = {k: v for k, v in pair.items() if k[0] == b}
        if not ends:
            return p1(c)
        total = sum(ends.values())
        return max(pair.get((b, c), 0) - d2, 0) / total + d2 * len(ends) / total * p1(c)

    def p3(a, b, c):
        ends = {k: v for k, v in counts.items() if k[:2] == (a, b)}
        if not ends:
            return p2(b, c)
        total = sum(ends.values())
        return max(counts.get((a, b, c), 0) - d3, 0) / total + d3 * len(ends) / total * p2(b, c)

    return p3


def test_model_is_kneser_ney_by_its_definition(spark):
    from collections import Counter

    rows = [r for r in made(40) if r[2] == "cc"]
    docs = documents(spark, rows)
    model = x.fit_models(docs)[0]
    counts = Counter()
    for r in rows:
        text = "".join(c if c.isalpha() else " " for c in r[1].lower())
        for word in text.split():
            padded = [0, 0, *map(ord, word), 0]
            counts.update(zip(padded, padded[1:], padded[2:]))
    p = brute_probability(dict(counts))
    letters = sorted({c for k in counts for c in k} | {ord("ж")})
    asked = [(a, b, c) for a in letters for b in letters for c in letters if (b or c) and (b or not a)]
    got = model.log_probability(np.array([a << 42 | b << 21 | c for a, b, c in asked]))
    assert np.allclose(got, [np.log(p(*k)) for k in asked])


def test_null_and_repeated_ids(spark):
    rows = [*made(200), (None, "ka lo mi tu", "aa", *[None] * 5), (5, "schein verzig", None, *[None] * 5)]
    got = x.language_id(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id is None} == {"aa"} and "bb" in {r.lang_pred for r in got if r.doc_id == 5}


def test_what_is_sent_is_bounded_over_all_languages(spark):
    docs = spark.createDataFrame([(f"l{k}", f"some words of language {k} " + chr(97 + k) * 3) for k in range(6)], "lang string, text string")
    one = max(r["count"] for r in x.count_trigrams(docs).groupBy("lang").count().collect())
    assert isinstance(x.fit_models(docs, most=2 * one), x.Tables)
    assert len(x.fit_models(docs, most=6 * one)) == 6
