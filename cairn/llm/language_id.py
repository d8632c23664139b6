"""Language identification by interpolated Kneser-Ney character trigram models.

Text is lower-cased; every run of non-letters is one boundary. A trigram is one
63-bit number (three code points of 21 bits), and each language's model is a set of
sorted arrays of such numbers with log probabilities beside them: interpolated
trigrams and bigrams, back-off weights, and unigrams. Languages with more trigrams
than can be sent, all counted together, keep them all in tables: the fit is made of grouped sums, the
frequent trigrams are sent with their probabilities, and documents' other trigrams
are looked up by joins. A document gets the language of the least cross-entropy per
character. Rejection is calibrated on labelled
documents that the models were not fitted on: per language and length class, the
cross-entropy that all but a stated share of its documents stay below. A class with
few of them borrows from neighbouring classes, then from its language, then from all
languages, so that there is a limit for every class at every size.

Defined cases: a text that is null or has no letter is `und` with score 0; a null
language label is not learned from, nor is a row with a null doc_id; rows that repeat
a doc_id are predicted each;
with nothing to learn from everything is `und`; with no calibration document at all
only `und` is rejected; an empty table gives no rows; a very long text is read in pieces that overlap by two characters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut

UNKNOWN = "und"
TOLD = "lang_pred string, cross_entropy double, letters long, score double"
#: Characters held at once; longer texts and batches are read in pieces.
PIECE = 1 << 19
#: Trigrams of all languages together up to which models are broadcast whole; beyond it they stay in tables, and as many numbers are broadcast.
MODEL_NGRAMS = 4_000_000
#: Share of a language's documents that calibration lets be rejected, and standard errors by which what it estimates is raised.
FALSE_REJECTION, ERRORS = 0.001, 3.0
#: Width of the calibration histogram in nats, documents that a length class needs to borrow none, and the last class (by powers of two of letters).
BIN, LEAST_DOCS, LAST_CLASS = 0.01, 200, 12
#: Letters beyond which more evidence does not sharpen the score.
SURE_LETTERS = 40
BITS = 21
MASK = (1 << BITS) - 1
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows): the trigrams of texts and the row each is from, in bounded pieces."""
    parts: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        parts.append((row, " "))
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE].lower()
            parts.append((row, piece))
            held += len(piece)
            if held >= PIECE:
                yield _keys(parts)
                tail = (" " + piece)[-2:]
                parts, held = [(-1, tail[:-1]), (row, tail[-1:])], 0  # context only: row -1 makes no trigram
        parts.append((row, " "))
    if parts:
        yield _keys(parts)


def _keys(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams whose last two characters are of one row; boundaries surround a document."""
    codes = np.frombuffer("".join([" ", *(p for _, p in parts)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.array([-1, *(r for r, _ in parts)]), [1, *(len(p) for _, p in parts)])
    codes[~_letters()[codes]] = 0
    two, three = codes[1:-1], codes[2:]
    one = np.where(two == 0, 0, codes[:-2])  # before a boundary nothing counts
    keep = ((two != 0) | (three != 0)) & (rows[2:] == rows[1:-1]) & (rows[2:] >= 0)
    keys = (one << 2 * BITS | two << BITS | three)[keep]
    return keys, rows[2:][keep]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them.

    Where few code points occur, a table over their triples takes the place of sorting.
    """
    used = np.flatnonzero(np.bincount(keys & MASK, minlength=1))
    used = np.union1d(used, np.flatnonzero(np.bincount(keys >> BITS & MASK, minlength=1)))
    used = np.union1d(used, np.flatnonzero(np.bincount(keys >> 2 * BITS, minlength=1)))
    n = len(used)
    if n > 160:
        return np.unique(keys, return_inverse=True)
    small = np.zeros(int(used[-1]) + 1 if n else 1, np.int32)
    small[used] = np.arange(n)
    dense = (small[keys >> 2 * BITS] * n + small[keys >> BITS & MASK]) * n + small[keys & MASK]
    there = np.zeros(n**3, bool)
    there[dense] = True
    cells = np.flatnonzero(there)
    place = np.zeros(n**3, np.int32)
    place[cells] = np.arange(len(cells))
    a, rest = np.divmod(cells, n * n)
    b, c = np.divmod(rest, n)
    return used[a] << 2 * BITS | used[b] << BITS | used[c], place[dense]


@dataclass
class Model:
    """One language: sorted keys with natural logarithms beside them."""

    lang: str
    tri: np.ndarray
    tri_log: np.ndarray
    pair: np.ndarray
    pair_log: np.ndarray
    tri_back: np.ndarray
    tri_back_log: np.ndarray
    pair_back: np.ndarray
    pair_back_log: np.ndarray
    uni: np.ndarray
    uni_log: np.ndarray
    unseen: float

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(third | first two) for each key."""
        last, tail, lead = keys & MASK, keys & (1 << 2 * BITS) - 1, keys >> BITS
        uni = _look(self.uni, self.uni_log, last, self.unseen)
        pair = _look(self.pair, self.pair_log, tail, np.nan)
        pair = np.where(np.isnan(pair), _look(self.pair_back, self.pair_back_log, tail >> BITS, 0.0) + uni, pair)
        tri = _look(self.tri, self.tri_log, keys, np.nan)
        return np.where(np.isnan(tri), _look(self.tri_back, self.tri_back_log, lead, 0.0) + pair, tri)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _grouped(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, s, len(found)) for s in sums)


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(min(0.95, max(0.1, one / (one + 2 * two)))) if one else 0.5


def fit_model(lang: str, keys: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from trigram counts; lower orders use continuation counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(float)
    ones = np.ones(len(keys))
    d3 = _discount(counts)
    lead, lead_sum, lead_types = _grouped(keys >> BITS, counts, ones)
    pair, pair_sum = _grouped(keys & (1 << 2 * BITS) - 1, ones)
    d2 = _discount(pair_sum)
    mid, mid_sum, mid_types = _grouped(pair >> BITS, pair_sum, np.ones(len(pair)))
    uni, uni_sum = _grouped(pair & MASK, np.ones(len(pair)))
    d1 = _discount(uni_sum)
    floor = d1 * len(uni) / uni_sum.sum() / (len(uni) + 1000)  # spread over letters seen and a thousand others
    p1 = np.maximum(uni_sum - d1, 0) / uni_sum.sum() + floor
    back2 = d2 * mid_types / mid_sum
    at = np.searchsorted(mid, pair >> BITS)
    p2 = np.maximum(pair_sum - d2, 0) / mid_sum[at] + back2[at] * p1[np.searchsorted(uni, pair & MASK)]
    back3 = d3 * lead_types / lead_sum
    at = np.searchsorted(lead, keys >> BITS)
    p3 = np.maximum(counts - d3, 0) / lead_sum[at] + back3[at] * p2[np.searchsorted(pair, keys & (1 << 2 * BITS) - 1)]
    return Model(lang, keys, np.log(p3), pair, np.log(p2), lead, np.log(back3), mid, np.log(back2), uni, np.log(p1), float(np.log(floor)))


def count_trigrams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, key, n over all documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(t)
            for name, texts in by_lang.items():
                for keys, _ in trigrams(texts):
                    if len(keys):
                        found, place = _distinct(keys)
                        old = total.get(name, (np.zeros(0, np.int64), np.zeros(0)))
                        total[name] = _grouped(np.concatenate([old[0], found]), np.concatenate([old[1], np.bincount(place, minlength=len(found))]))
        for name, (keys, n) in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "n": pa.array(n.astype(np.int64))})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Tables:
    """All languages: natural logarithms of probabilities and back-off weights, by lang and code points."""

    names: list[str]
    counts: DataFrame
    tri: DataFrame
    pair: DataFrame
    lead: DataFrame
    mid: DataFrame
    uni: DataFrame
    whole: DataFrame


def _sql_discount(n: str = "n") -> Column:
    one, two = F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)
    return F.when(one > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), one / (one + 2 * two)))).otherwise(0.5)


def _lead(key: str) -> Column:
    return F.shiftright(key, BITS)


def _last(key: str, letters: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << letters * BITS) - 1))


def fit_tables(counts: DataFrame, names: list[str]) -> Tables:
    """What fit_model gives for each language, as tables; a group has at most a row a letter."""
    sums = F.sum("n").alias("total"), F.count("*").alias("types")
    pairs = cut(counts.groupBy("lang", _last("key", 2).alias("pair")).agg(F.count("*").alias("n")), "pairs")
    ends = pairs.groupBy("lang", _last("pair", 1).alias("uni")).agg(F.count("*").alias("n"))
    d3, d2 = (F.broadcast(t.groupBy("lang").agg(_sql_discount().alias("d"))) for t in (counts, pairs))  # a row a language
    floor = F.col("d") * F.col("types") / F.col("total") / (F.col("types") + 1000)
    whole = cut(ends.groupBy("lang").agg(*sums, _sql_discount().alias("d")).withColumn("floor", floor), "whole")
    less = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
    uni = cut(ends.join(F.broadcast(whole), "lang").select("lang", "uni", (less + F.col("floor")).alias("p")), "uni")
    back = (F.col("d") * F.col("types") / F.col("total")).alias("back")
    mid = cut(pairs.groupBy("lang", _lead("pair").alias("mid")).agg(*sums).join(d2, "lang").select("lang", "mid", "total", back, "d"), "mid")
    pair = pairs.withColumns({"mid": _lead("pair"), "uni": _last("pair", 1)}).join(mid, ["lang", "mid"]).join(uni, ["lang", "uni"])
    pair = cut(pair.select("lang", "pair", (less + F.col("back") * F.col("p")).alias("p")), "pair")
    lead = cut(counts.groupBy("lang", _lead("key").alias("lead")).agg(*sums).join(d3, "lang").select("lang", "lead", "total", back, "d"), "lead")
    tri = counts.withColumns({"lead": _lead("key"), "pair": _last("key", 2)}).join(lead, ["lang", "lead"]).join(pair, ["lang", "pair"])
    tri = cut(tri.select("lang", "key", F.log(less + F.col("back") * F.col("p")).alias("tri_log")), "tri")
    return Tables(
        names, counts, tri, pair.select("lang", "pair", F.log("p").alias("pair_log")), lead.select("lang", "lead", F.log("back").alias("lead_back")),
        mid.select("lang", "mid", F.log("back").alias("mid_back")), uni.select("lang", "uni", F.log("p").alias("uni_log")), whole.select("lang", F.log("floor").alias("unseen")),
    )


def probabilities(keys: DataFrame, t: Tables) -> DataFrame:
    """key and its natural logarithm of probability in each language, l0, l1, ..., for distinct keys."""
    pairs = keys.select(_last("key", 2).alias("pair")).distinct().crossJoin(F.broadcast(t.whole))  # a row a language
    pairs = pairs.withColumns({"mid": _lead("pair"), "uni": _last("pair", 1)})
    pairs = pairs.join(t.pair, ["lang", "pair"], "left").join(t.mid, ["lang", "mid"], "left").join(t.uni, ["lang", "uni"], "left")
    pairs = pairs.select("lang", "pair", F.coalesce("pair_log", F.coalesce("mid_back", F.lit(0.0)) + F.coalesce("uni_log", "unseen")).alias("low"))
    rows = keys.crossJoin(F.broadcast(t.whole.select("lang"))).withColumns({"lead": _lead("key"), "pair": _last("key", 2)})
    rows = rows.join(pairs, ["lang", "pair"]).join(t.tri, ["lang", "key"], "left").join(t.lead, ["lang", "lead"], "left")
    log = F.coalesce("tri_log", F.coalesce("lead_back", F.lit(0.0)) + F.col("low"))
    return rows.groupBy("key").agg(*(F.max(F.when(F.col("lang") == name, log)).alias(f"l{j}") for j, name in enumerate(t.names)))


def fit_models(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MODEL_NGRAMS) -> list[Model] | Tables:
    """A model for each language of docs, from all its texts; tables where all languages together have over `most` trigrams."""
    counts = cut(count_trigrams(docs, lang, text), "counts")
    types = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}
    if sum(types.values()) > most:
        return fit_tables(counts, sorted(types))
    return [fit_model(name, own["key"].to_numpy(), own["n"].to_numpy()) for name, own in counts.toPandas().groupby("lang")]


def _told(names: list[str], sums: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    """The language of each row from its sums of logarithms (rows x languages) over n trigrams."""
    cross = -sums / np.maximum(n, 1)[:, None]
    best = cross.argmin(1)
    least = cross[np.arange(len(n)), best]
    weight = 1 / np.exp((least[:, None] - cross) * np.minimum(n, SURE_LETTERS)[:, None]).sum(1)
    some = n > 0
    return {
        "lang_pred": pa.array([names[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], pa.string()),
        "cross_entropy": pa.array(np.where(some, least, 0.0)),
        "letters": pa.array(n.astype(np.int64)),
        "score": pa.array(np.where(some, weight, 0.0)),
    }


def _scorer(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            sums, n = np.zeros((len(texts), len(models))), np.zeros(len(texts))
            for keys, rows in trigrams(texts):
                if not len(keys):
                    continue
                found, place = _distinct(keys)
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                n[rows[starts]] += np.diff(np.r_[starts, len(rows)])
                for j, m in enumerate(models):
                    sums[rows[starts], j] += np.add.reduceat(m.log_probability(found)[place], starts)
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in names} | _told([m.lang for m in models], sums, n))

    return run


def _head_scorer(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            sums, n = np.zeros((len(texts), len(logs))), np.zeros(len(texts), np.int64)
            left = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for keys, rows in trigrams(texts):
                if not len(keys):
                    continue
                found, place = _distinct(keys)
                at = np.minimum(np.searchsorted(head, found), len(head) - 1)
                there = head[at] == found
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                n[rows[starts]] += np.diff(np.r_[starts, len(rows)])
                for j, log in enumerate(logs):
                    sums[rows[starts], j] += np.add.reduceat(np.where(there, log[at], 0.0)[place], starts)
                out = ~there[place]
                left.append((rows[out], keys[out]))
            rows, keys = (np.concatenate(c) for c in zip(*left, strict=True))
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, int)
            many = pa.StructArray.from_arrays([pa.array(keys[first], pa.int64()), pa.array(np.diff(np.r_[first, len(rows)]).astype(np.int64))], ["key", "n"])
            made = {
                "sums": pa.array(list(sums), pa.list_(pa.float64())),
                "letters": pa.array(n),
                "rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[first], np.arange(len(texts) + 1)).astype(np.int32)), many),
            }
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in names} | made)

    return run


def _teller(langs: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.stack([b.column(f"l{j}").to_numpy(zero_copy_only=False) for j in range(len(langs))], 1)
            told = _told(langs, sums, b.column("letters").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in names} | told)

    return run


def _score_by_tables(rows: DataFrame, t: Tables, names: list[str], fields: str, most: int) -> DataFrame:
    """Frequent trigrams by a broadcast of `most` numbers, at least one a language, all others by joins on their distinct keys."""
    logs = [f"l{j}" for j in range(len(t.names))]
    top = t.counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(max(1, most // len(logs))).select("key")
    head = probabilities(cut(top, "top"), t).orderBy("key").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((head["key"].to_numpy(), [head[c].to_numpy() for c in logs]))
    summed = rows.mapInArrow(_head_scorer(shared, names), fields + ", sums array<double>, letters long, rest array<struct<key: long, n: long>>")
    summed = cut(summed.withColumn("row", F.monotonically_increasing_id()), "head")
    rest = summed.select("row", F.inline("rest"))
    found = cut(probabilities(cut(rest.select("key").distinct(), "keys"), t), "rest")
    more = rest.join(found, "key").groupBy(F.col("row").alias("of")).agg(*(F.sum(F.col("n") * F.col(c)).alias(c) for c in logs))
    both = summed.join(more, F.col("row") == F.col("of"), "left")
    both = both.select(*names, "letters", *((F.col("sums")[j] + F.coalesce(c, F.lit(0.0))).alias(c) for j, c in enumerate(logs)))
    return both.mapInArrow(_teller(t.names, names), f"{fields}, {TOLD}")


def score(docs: DataFrame, models: list[Model] | Tables, keys: dict[str, Column], text: str = "text", most: int = MODEL_NGRAMS, with_text: bool = False) -> DataFrame:
    """The key columns, the text if wanted, and lang_pred, cross_entropy, letters, score for every row."""
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text).alias("text"))
    keys = [*keys, "text"] if with_text else list(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    if isinstance(models, Tables):
        return _score_by_tables(rows, models, keys, fields, most)
    if not models:
        return rows.select(*keys).withColumns({"lang_pred": F.lit(UNKNOWN), "cross_entropy": F.lit(0.0), "letters": F.lit(0).cast("long"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by MODEL_NGRAMS in all
    return rows.mapInArrow(_scorer(shared, keys), f"{fields}, {TOLD}")


def _tail(excess: np.ndarray, n: np.ndarray, share: float) -> tuple[float, float]:
    """What all but `share` of excesses over a centre stay below, and the mean upper excess.

    The limit is the quantile itself, or with too few documents to hold one the greatest
    excess and an exponential tail beyond it; at least what such a tail makes of the upper
    half. Means are raised for their error.
    """
    order = np.argsort(excess)
    excess, n = excess[order], n[order]
    total, up = n.sum(), np.cumsum(n)
    over = lambda at: max(BIN, float(((excess - excess[at]) * n)[at:].sum() / n[at:].sum()))
    half, tenth = (over(min(np.searchsorted(up, total * q), len(n) - 1)) for q in (0.5, 0.9))
    raised = 1 + ERRORS * np.sqrt(2 / total)
    quantile = float(excess[np.searchsorted(up, total * (1 - share))])
    beyond = max(half, tenth) * raised * max(0.0, np.log(1 / (total * share)))
    return max(quantile + beyond, half * raised * np.log(0.5 / share)), half


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def calibrated(bins: pd.DataFrame, names: list[str], false_rejection: float = FALSE_REJECTION) -> list[tuple[str, int, float]]:
    """(lang_pred, size_class, limit) for every language and class, from a histogram (lang_pred, size_class, bin, n).

    A pool is as few classes about its own as hold LEAST_DOCS documents, of its language
    or else of all, each language taken from its own median. Fewer letters spread more:
    what longer texts exceed the centre by is scaled to the shorter length.
    """
    lang, size, n = bins["lang_pred"].to_numpy(object), bins["size_class"].to_numpy(int), bins["n"].to_numpy(float)
    value = (bins["bin"].to_numpy(float) + 1) * BIN
    if not n.sum():
        return []
    middle = {m: _median(value[lang == m], n[lang == m]) for m in set(lang)}
    centred = value - np.array([middle[m] for m in lang])
    out = []
    for name in names:
        for k in range(LAST_CLASS + 1):
            spread = np.sqrt(2.0 ** np.maximum(size - k, 0))
            for width in range(LAST_CLASS + 1):
                own = (lang == name) & (np.abs(size - k) <= width)
                if n[own].sum() >= LEAST_DOCS:
                    centre = _median(value[own], n[own])
                    limit = centre + _tail((value[own] - centre) * spread[own], n[own], false_rejection)[0]
                    break
            else:
                width = next((w for w in range(LAST_CLASS) if n[np.abs(size - k) <= w].sum() >= LEAST_DOCS), LAST_CLASS)
                near = np.abs(size - k) <= width
                reach, mean = _tail((centred * spread)[near], n[near], false_rejection)
                held = n[lang == name].sum()
                limit = (middle[name] + ERRORS * mean / np.sqrt(held) if held else max(middle.values())) + reach
            out.append((name, k, float(limit)))
    return out


def limits(scored: DataFrame, names: list[str], false_rejection: float = FALSE_REJECTION) -> DataFrame:
    """lang_pred, size_class, limit from calibration rows; the driver sees only their histogram, a few bins a class."""
    bins = scored.where("letters > 0 and lang_true = lang_pred").groupBy("lang_pred", _size_class().alias("size_class"), F.floor(F.col("cross_entropy") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    return scored.sparkSession.createDataFrame(calibrated(bins.toPandas(), names, false_rejection), "lang_pred string, size_class int, limit double")


def _size_class() -> Column:
    return F.least(F.floor(F.log2(F.greatest("letters", F.lit(1)))), F.lit(LAST_CLASS)).cast("int")


def language_id(docs: DataFrame, learn: Column | None = None, calibrate: Column | None = None, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", keys: dict[str, Column] | None = None, most: int = MODEL_NGRAMS, with_text: bool = False) -> DataFrame:
    """The keys, the text if wanted, and lang_pred, cross_entropy, letters, score, rejected for every row.

    learn and calibrate choose the rows whose label may be used to fit and to
    calibrate; by default those whose crc32(doc_id) % 4 is 0 or 1, and 3.
    """
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    learn = fold.isin(0, 1) if learn is None else learn
    calibrate = fold == 3 if calibrate is None else calibrate
    keys = {"doc_id": F.col(doc_id).cast("long")} if keys is None else keys
    models = fit_models(docs.where(learn), lang, text, most)
    names = models.names if isinstance(models, Tables) else [m.lang for m in models]
    inner = {f"key_{k}": c for k, c in keys.items()}
    scored = cut(score(docs, models, inner | {"lang_true": F.when(F.coalesce(calibrate, F.lit(False)), F.col(lang).cast("string"))}, text, most, with_text), "scored")
    allowed = cut(limits(scored, names), "limits")
    s, a = scored.withColumn("size_class", _size_class()).alias("s"), allowed.alias("a")
    out = s.join(a, (F.col("s.lang_pred") == F.col("a.lang_pred")) & (F.col("s.size_class") == F.col("a.size_class")), "left")
    over = (F.col("s.lang_pred") == UNKNOWN) | F.coalesce(F.col("s.cross_entropy") > F.col("a.limit"), F.lit(False))
    return out.select(*(F.col(f"s.key_{k}").alias(k) for k in keys), *(["s.text"] if with_text else []), "s.lang_pred", "s.cross_entropy", "s.letters", "s.score", over.alias("rejected"))
