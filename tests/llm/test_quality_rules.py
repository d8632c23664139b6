import math
import random
import re
from collections import Counter

from cairn.llm import quality_rules as x
from tests.llm.rows import awkward, documents

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_counts_against_brute_force(spark):
    phrase = "one two three four five six seven eight nine "
    rows = awkward() + [(900, phrase * 2 + "é|é\n \n a\na\n\x0ba\n" + phrase, *[None] * 6)]
    got = x.quality_rules(documents(spark, rows), spark.createDataFrame([], LABELS)).collect()
    have = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    want = []
    for r in rows:
        c = counts(r[1])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((r[0], *c, failed, not failed))
    assert have == sorted(want)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (400, 0.004), (3000, 0.02)):
        for k in {0, 1, n // 50, n // 3, n - 1, n}:
            exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 500 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert abs(x.binomial_tail(k, n, p) - min(1, exact)) < 1e-9


def test_certified_cutoff_rejects_bad_documents_only(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(40)) for _ in range(4000)]
    bad = [t.replace(" ", "### ") for t in good[:300]]
    rows = [(i, t, "en", *[None] * 5) for i, t in enumerate(good + bad)] + [(9999, bad[0], "rare", *[None] * 5)]
    labels = spark.createDataFrame([(i, int(i < 4000), 0) for i in range(0, 4300, 2)] + [(1, None, 0)], LABELS)
    got = {r.doc_id: r for r in x.quality_rules(documents(spark, rows), labels).collect()}
    assert all(got[i].kept for i in range(4000))
    assert not any(got[i].kept for i in range(4000, 4300)) and got[4001].rejected_by == "symbols"
    assert got[9999].kept  # a stratum without labels has no certified cutoff


def test_several_rules_are_certified_and_a_null_stratum_is_its_own(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9999))
    good = ["\n".join(" ".join(word() for _ in range(10)) for _ in range(5)) for _ in range(6000)]
    marked = [t.replace(" ", " ## ") for t in good[:250]]
    lined = [t + "\nsame short line" * 4 for t in good[:250]]
    loud = [t.upper() for t in good[:250]]
    texts = [(t, 1, None) for t in good] + [(t, 0, k) for k, ts in (("symbols", marked), ("lines", lined), ("upper", loud)) for t in ts]
    rows = [(i, t, None, *[None] * 5) for i, (t, _, _) in enumerate(texts)] + [(90_000, marked[0], "", *[None] * 5), (None, loud[0], None, *[None] * 5)]
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q, _) in enumerate(texts) if i % 3], LABELS)
    got = x.quality_rules(documents(spark, rows), labels).collect()
    told = {r.doc_id: r for r in got}
    lost = sum(not told[i].kept for i, (_, q, _) in enumerate(texts) if q)
    assert lost <= x.LIMIT * 6000
    for i, (_, _, why) in enumerate(texts):
        assert why is None or not told[i].kept, (i, why)
    assert {told[i].rejected_by for i, (_, q, _) in enumerate(texts) if not q} == {"symbols", "lines", "upper"}
    assert told[90_000].kept  # the empty name has no labels
    assert not told[None].kept


def test_empty_table(spark):
    assert x.quality_rules(documents(spark, []), spark.createDataFrame([], LABELS)).collect() == []
