import re
from collections import Counter, defaultdict

from cairn.llm import source_divergence as x
from cairn.llm.terms import LETTERS, blocks
from tests.llm.rows import awkward, documents

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=x.LEAST_DOCS, top=x.TOP):
    found, count, docs = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
        found[lang or ""].add(source or "")
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in found.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(held):
            size = sum(held[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + x.UNIT * (held[t] + 1) // size for t in kept}  # noqa: B023

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        own = {s: shares(count[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, held, most in (("pair", pairs, None), ("term", terms, top)):
                held.sort(key=lambda e: (-e[0], e[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(held[:most])]
    return sorted(out)


def found(spark, rows, **more):
    return sorted(map(tuple, x.source_divergence(documents(spark, rows), **more).collect()))


def test_against_brute_force(spark):
    rows = awkward()
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, top=2) == brute(rows, top=2)


def test_many_terms_and_small_stores(spark, monkeypatch):
    rows = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)} Ünï" for j in range(i, i + 90)), "en" if i % 3 else None, f"s{i % 5}", None, 1, 2, 3) for i in range(60)]
    monkeypatch.setattr(x, "HELD", 5)
    assert found(spark, rows) == brute(rows)


def test_groups_without_terms(spark):
    rows = [(1, "rare words", "en", "a", *[None] * 4), (2, None, "en", "b", *[None] * 4), (3, "12 34", None, None, *[None] * 4)]
    assert found(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert found(spark, []) == []


def test_blocks_end_between_words():
    text = "ab Cd  éé x1y " * 9 + "z" * 50
    for size in (1, 3, 7, 1000):
        words = [w for b in blocks(memoryview(text.encode()), LETTERS, size) for w in b.split()]
        assert words == text.lower().replace("x1y", "x y").encode().split()
