import random
import re

from cairn.llm import line_dedup as x
from tests.llm.rows import awkward, documents


def brute(rows):
    """Delete the lines of every stretch that is long enough and occurs earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        worded = [i for i, s in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", s)]
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) for i in worded]
        gone = set()
        for a in range(len(worded)):
            for b in range(a + 1, min(len(worded), a + 3) + 1):
                if b - a >= 3 or sum(words[a:b]) >= 50:
                    content = tuple(lines[i] for i in worded[a:b])
                    if content in seen:
                        gone |= set(range(a, b))
                    seen.add(content)
        drop = {worded[q] for q in gone}
        runs, q = [], 0
        while q < len(worded):
            if q in gone:
                a = q
                while q in gone:
                    q += 1
                runs.append(f"{a}:{q}")
            q += 1
        clean = "\n".join(s for i, s in enumerate(lines) if i not in drop)
        out[doc_id] = (None if text is None else clean, len(worded), len(gone), ",".join(runs))
    return sorted((r[0], *out[r[0]]) for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(9)
    short = ["a b", "c", "d e f", "g", "", "  ", "h i"]
    long = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) for n in (26, 30, 50, 70)]
    texts = ["\n".join(rng.choice(short + long) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)] + [(r[0] + 1000, *r[1:]) for r in awkward()]
    got = sorted(map(tuple, x.line_dedup(documents(spark, rows)).collect()))
    assert got == brute(rows)


def test_null_id_is_left_alone_and_empty(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [(None, text, *[None] * 6), (1, text, *[None] * 6), (2, text, *[None] * 6)]
    got = {r.doc_id: r for r in x.line_dedup(documents(spark, rows)).collect()}
    assert got[None].text == text and got[1].text == text and got[2].text == "" and got[2].runs == "0:4"
    assert x.line_dedup(documents(spark, [])).collect() == []
