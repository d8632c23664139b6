import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
from tests.llm.rows import awkward, documents
from tests.llm.test_language_id import SYLLABLES
from tests.llm.test_ngram_join import brute


def rows():
    rng = random.Random(8)
    out = []
    for i in range(200):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(12, 60)))
        if i % 9 == 1 and out:
            text = rng.choice(out)[1]
        if i % 9 == 2 and out:
            text = rng.choice(out)[1] + " ka"
        out.append((i, text, lang, f"s{i % 4}", len(text), 1, 2, 3))
    return out + [(300, None, "aa", None, 0, 1, 2, 3), (301, "?!", "aa", "s0", 2, 1, 2, 3), (None, "ka lo mi", "aa", "s0", 2, 1, 2, 3)]


def test_stages(spark):
    docs, plain = documents(spark, rows()), rows()
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, "")
    assert first.columns == docs.columns
    order = lambda rs: sorted(map(tuple, rs), key=lambda r: (r[0] is None, r[0] or 0))
    plain = [r for r in plain if re.search("[a-z]", r[1] or "")]
    assert order(first.collect()) == order(plain)
    second = stages["exact_dedup"](spark, first, "")
    best = {}
    for r in plain:
        best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
    plain = [r for r in plain if best[r[1]] == (-1 if r[0] is None else r[0])]
    assert order(second.collect()) == order(plain)
    third = stages["ngram_join"](spark, second, "")
    alone = {d for d, _, c in brute([(10**9 if r[0] is None else r[0], *r[1:]) for r in plain]) if d == c}
    plain = [r for r in plain if (10**9 if r[0] is None else r[0]) in alone]
    assert order(third.collect()) == order(plain)
    fourth = [tuple(r) for r in stages["mixing"](spark, third, "").collect()]
    count = defaultdict(int)
    for r in fourth:
        count[r] += 1
    assert set(count) <= set(plain) and max(count.values()) <= 2
    size = lambda rs: sum(len(r[1].split()) for r in rs)
    assert abs(size(fourth) - 1.5 * size(plain)) <= 60 * 4
    last = stages["best_fit_packing"](spark, documents(spark, fourth), "").collect()
    pieces = defaultdict(int)
    for r in last:
        pieces[r.doc_id] += r.piece == 0
    assert sum(pieces.values()) == len(fourth) and zlib.crc32(b"") == 0


def test_columns_of_any_name_and_ids_that_repeat(spark):
    names = "doc_id long, text string, lang string, source string, id long, digest string, copy int, copies int, kept boolean, score double, text_sha256 string"
    base = [r for r in rows() if r[1]]
    odd = [(*r[:4], 7, "d", 1, 2, False, 0.5, "s") for r in base]
    odd += [(5, "ka lo mi tu ka lo tu mi lo " * 3, "aa", "s1", 7, "d", 1, 2, False, 0.5, "s"), (None, "tu mi ka lo mi ka lo tu " * 4, "aa", None, 7, "d", 1, 2, False, 0.5, "s")]
    docs = spark.createDataFrame(odd, names)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, docs, "")
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
        some = docs.first()
        assert (some["id"], some["digest"], some["copy"], some["copies"], some["kept"], some["score"]) == (7, "d", 1, 2, False, 0.5)
        if name != "mixing":  # a second text of doc_id 5 and a text without id are documents like others
            held = {(r.doc_id, r.text) for r in docs.collect()}
            assert {(odd[-2][0], odd[-2][1]), (odd[-1][0], odd[-1][1])} <= held
            assert any(d == 5 and t != odd[-2][1] for d, t in held) or name != "language_id"
    assert stages["best_fit_packing"](spark, docs, "").count() > 0


def test_awkward_rows_and_empty(spark):
    docs = documents(spark, awkward())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.columns[:2] == ["doc_id", "piece"]
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
