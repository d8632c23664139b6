"""Benchmark passages found in documents by a suffix automaton of the test items.

Items are normalised to words (A-Z lower-cased, runs of letters, digits and characters
beyond ASCII) and a generalised suffix automaton over their word numbers is built: every
path from its start is a run of words of some item. The words of a document stream
through it, which tells at each word the length of the longest run of item words that
ends there. A run as long as the window ends a window of every item that its state names;
an item shorter than the window is one window, found on the chain of suffix links. Words
inside any such window are hit, and neighbouring hit words form a span.

`decontaminate` cuts out the spans of at least `span` words, and a document of which more
than a share of `coverage` is hit is dropped whole (its clean text is null).

Automata have a bounded size: items are cut into overlapping pieces, so that no window is
lost, and dealt to shards of some SHARD_WORDS words; each shard's automaton is built in a
task, and is a broadcast of its own. Documents are read once for each shard (once in all,
until a benchmark has more words than a shard). They are never shuffled.

Defined cases: a null text has no words, and an item without words is never found; a null
item_id reads as ''; items that repeat an id are found under that one id; rows that repeat
a document are found each by itself; a word longer than a block is one word; empty tables
on either side find nothing; other columns are not read.
"""

from __future__ import annotations

import pickle
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.terms import LETTERS_AND_DIGITS, blocks, texts
from cairn.session import cut

WINDOW = 10
#: Words of the items of one automaton, and of a piece of an item.
SHARD_WORDS, PIECE_WORDS = 1 << 19, 1 << 14
SPAN, COVERAGE = 10, 0.5
STATE = "n_words long, longest long, spans array<struct<start:long,words:long>>, items array<string>"


class Automaton:
    """A generalised suffix automaton of word runs; every run of an added item is a path."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the runs of q that are no longer than those that come from p."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def add(self, words: list[bytes]) -> None:
        at = 0
        for w in words:
            word = self.numbers.setdefault(w, len(self.numbers))
            if word in self.next[at]:
                at = self._split(at, self.next[at][word], word)
                continue
            own, p = self._state(self.length[at] + 1, 0, {}), at
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = own
                p = self.link[p]
            if p >= 0:
                self.link[own] = self._split(p, self.next[p][word], word)
            at = own

    def packed(self, items: list[tuple[str, list[bytes]]], window: int) -> bytes:
        """What a reader needs, once all items are in: arrays, and the items of each state of the window's length."""
        names = sorted({i for i, words in items if words})
        number = {n: k for k, n in enumerate(names)}
        ends: dict[int, set[int]] = defaultdict(set)
        short: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, words in items:
            at = 0
            for k, w in enumerate(words):
                at = self.next[at][self.numbers[w]]
                if k + 1 >= window:
                    top = at
                    while self.length[self.link[top]] >= window:
                        top = self.link[top]
                    ends[top].add(number[name])
            if words and len(words) < window:
                short[at][len(words)].add(number[name])
        size = len(self.numbers)
        keys, to = array("q"), array("q")
        for s, after in enumerate(self.next):
            for w, t in after.items():
                keys.append(s * size + w)
                to.append(t)
        plain = lambda d: {k: sorted(v) for k, v in d.items()}
        return pickle.dumps({"window": window, "words": list(self.numbers), "keys": keys, "to": to, "link": array("q", self.link), "length": array("q", self.length), "names": names, "ends": plain(ends), "short": {s: plain(v) for s, v in short.items()}})


class Reader:
    """Streams words through a packed automaton."""

    def __init__(self, packed: bytes):
        p = pickle.loads(packed)
        self.window, self.names, self.ends = p["window"], p["names"], p["ends"]
        self.number = {w: k for k, w in enumerate(p["words"])}.get
        self.size = len(p["words"])
        self.after = dict(zip(p["keys"], p["to"], strict=True))
        self.link, self.length = p["link"].tolist(), p["length"].tolist()
        #: for each state the nearest on its chain, itself included, at which a short item ends
        self.short, self.nearest = p["short"], [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]] if s else -1
        self.least = min([self.window, *(n for held in self.short.values() for n in held)])

    def _found(self, state: int, run: int, items: set[int], tops: set[int]) -> int:
        """How many words back the longest window that ends here reaches; its items and those of shorter ones are noted."""
        longest = 0
        if run >= self.window:
            while self.length[self.link[state]] >= self.window:
                state, run = self.link[state], self.length[self.link[state]]
            tops.add(state)
            longest = self.window
        at = self.nearest[state]
        while at >= 0:
            for n, own in self.short[at].items():
                if n <= run or at != state:
                    items.update(own)
                    longest = max(longest, n)
            at = self.nearest[self.link[at]] if at else -1
        return longest

    def read(self, text: memoryview) -> tuple[int, int, list[tuple[int, int]], list[str]]:
        """Words, the longest run of item words, spans (start, words) that are hit, and the items found."""
        after, link, length, size, least = self.after.get, self.link, self.length, self.size, self.least
        base = longest = state = run = 0
        spans: list[list[int]] = []
        items: set[int] = set()
        tops: set[int] = set()
        for block in blocks(text, LETTERS_AND_DIGITS):
            numbers = list(map(self.number, block.split()))
            for i, w in enumerate(numbers):
                if w is None:
                    state = run = 0
                    continue
                to = after(state * size + w)
                while to is None and state:
                    state = link[state]
                    run = length[state]
                    to = after(state * size + w)
                if to is None:
                    run = 0
                    continue
                state = to
                run += 1
                if run > longest:
                    longest = run
                if run >= least and (back := self._found(state, run, items, tops)):
                    end = base + i + 1
                    while spans and spans[-1][0] >= end - back:
                        spans.pop()
                    if spans and spans[-1][1] >= end - back:
                        spans[-1][1] = end
                    else:
                        spans.append([end - back, end])
            base += len(numbers)
        for s in tops:
            items.update(self.ends[s])
        return base, longest, [(a, b - a) for a, b in spans], [self.names[k] for k in sorted(items)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, words) without overlap; those that touch are one."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def without_spans(text: memoryview, spans: list[tuple[int, int]]) -> str:
    """The text less the spans, from the first byte of a span's first word to the last of its last."""
    kept, at, base, offset = [], 0, 0, 0
    todo = [(a, a + n - 1) for a, n in spans]
    k = 0
    for block in blocks(text, LETTERS_AND_DIGITS):
        inside = np.frombuffer(block, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        while k < len(todo):
            first, last = todo[k]
            if base <= first < base + len(starts):
                kept.append(bytes(text[at : offset + int(starts[first - base])]))
            if last >= base + len(starts):
                break
            at = offset + int(ends[last - base])
            k += 1
        base += len(starts)
        offset += len(block)
    kept.append(bytes(text[at:]))
    return b"".join(kept).decode()


def _pieces(window: int):
    """Items as (item, piece, words): pieces overlap by window - 1 words, so each window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("item").to_pylist(), texts(b.column("text")), strict=True):
                held, last = [], False
                for block in blocks(text, LETTERS_AND_DIGITS):
                    held += block.split()
                    while len(held) > PIECE_WORDS:
                        yield pa.RecordBatch.from_pydict({"item": [name], "words": [b" ".join(held[:PIECE_WORDS])], "n": [PIECE_WORDS]})
                        held, last = held[PIECE_WORDS - window + 1 :], True
                if len(held) >= (window if last else 1):
                    yield pa.RecordBatch.from_pydict({"item": [name], "words": [b" ".join(held)], "n": [len(held)]})

    return run


def build(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """shard, automaton: the packed automata of the items."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = cut(rows.mapInArrow(_pieces(window), "item string, words binary, n long").distinct(), "pieces")
    shards = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [(i, w.split()) for i, w in sorted(zip(pdf["item"], pdf["words"], strict=True))]
        auto = Automaton()
        for _, words in held:
            auto.add(words)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "automaton": [auto.packed(held, window)]})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, shards))).cast("int"))
    return cut(dealt.groupBy("shard").applyInPandas(shard, "shard int, automaton binary"), "automata")


def _scan(packed, keys: list[str]):
    """One automaton over documents that carry what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(packed.value)
        for b in batches:
            before = b.column("spans").to_pylist(), b.column("items").to_pylist(), b.column("longest").to_pylist()
            out: dict[str, list] = {"n_words": [], "longest": [], "spans": [], "items": []}
            for text, spans, items, longest in zip(texts(b.column("text")), *before, strict=True):
                n, most, more, names = reader.read(text)
                own = merged([(s["start"], s["words"]) for s in spans] + more) if spans else more
                out["n_words"].append(n)
                out["longest"].append(max(longest, most))
                out["spans"].append([{"start": a, "words": w} for a, w in own])
                out["items"].append(sorted({*items, *names}) if items else names)
            kinds = {"n_words": pa.int64(), "longest": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])), "items": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keys} | {c: pa.array(out[c], t) for c, t in kinds.items()})

    return run


def _clean(span: int, coverage: float, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for text, spans, n in zip(texts(b.column("text")), b.column("spans").to_pylist(), b.column("n_words").to_pylist(), strict=True):
                hit = sum(s["words"] for s in spans)
                clean.append(None if hit > coverage * n else without_spans(text, [(s["start"], s["words"]) for s in spans if s["words"] >= span]))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keys} | {"clean": pa.array(clean, pa.string())})

    return run


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keys: dict[str, Column] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", with_clean: bool = False, span: int = SPAN, coverage: float = COVERAGE) -> DataFrame:
    """The key columns (doc_id by default), n_words, longest, spans of hit words, items found in order of their names; clean, if asked for."""
    if window < 1:
        raise ValueError("a window has at least one word")
    keys = keys or {"doc_id": F.col("doc_id")}
    names = list(keys)
    none = {"longest": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,words:long>>"), "items": F.array().cast("array<string>")}
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.coalesce(F.col(text), F.lit("")).alias("text"), *(c.alias(k) for k, c in none.items()))
    automata = build(items, window, item_id, item_text)
    shards = sorted(r[0] for r in automata.select("shard").collect()) or [None]
    for k, shard in enumerate(shards):
        blob = Automaton().packed([], window) if shard is None else automata.where(F.col("shard") == shard).first()["automaton"]  # SHARD_WORDS words
        carried = [*names, "text"] if with_clean or k + 1 < len(shards) else names
        packed = docs.sparkSession.sparkContext.broadcast(blob)
        rows = rows.mapInArrow(_scan(packed, carried), f"{_fields(rows, carried)}, {STATE}")
        if k + 1 < len(shards):
            rows = cut(rows, "scanned")
    if with_clean:
        kept = [*names, "n_words", "longest", "spans", "items"]
        rows = rows.mapInArrow(_clean(span, coverage, kept), f"{_fields(rows, kept)}, clean string")
    return rows


def digests(found: DataFrame) -> DataFrame:
    """What was found, as counts and the SHA-256 of the items' names."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT item, len(w) AS n, array_to_string(w, ' ') AS s FROM i WHERE len(w) BETWEEN 1 AND {WINDOW - 1}
  UNION SELECT item, {WINDOW}, array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ') FROM (SELECT item, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM i WHERE len(w) >= {WINDOW})),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("text")} AS w FROM documents),
ln AS (SELECT DISTINCT n FROM win),
g AS (SELECT row, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ln WHERE len(w) >= n)),
m AS (SELECT g.row, g.k, g.n, win.item FROM g JOIN win ON g.n = win.n AND g.s = win.s),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM m) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM m) GROUP BY row)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN it USING (row)"""
