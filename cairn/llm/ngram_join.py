"""Jaccard self-join of word 5-gram sets: a size-aware heavy-light join.

Documents with one set form a class. Two classes link when 100 * |A and B| >=
80 * |A or B|; for sizes s and t that is an overlap of ceil(4 (s + t) / 9).

Light: where the smaller size is at most the boundary, both sides enumerate all
subsets of the overlap's size; sharing one proves the link, so each subset's classes
form a star and no pairs are listed. Heavy: larger sets are found in inverted lists
over rare-first prefixes. The boundary is where the two costs, counted from the size
histogram, sum to least. Rareness comes from a mergeable count of every task's
repeated grams, then from the lists themselves: grams of crowded lists move back in
the order and the classes they led are listed anew. The order never decides a result.

Pairs are first held against parity signatures, which rule most out for certain, then
decided by whole sets. A list of near copies is not paired up: its members are compared
with a leader, the links are contracted to components, lists that still span several
components get other leaders, and when few are left, every pair of like sizes across
components is compared. A pair inside one component cannot change it, a pair across
components is always compared: no link between components is lost.

Defined cases: A-Z are lower-cased, a null text or one without words has an empty set
and is alone; with fewer than five words the whole sequence is the one gram; rows that
repeat a doc_id are rows of their class; a null doc_id takes the least doc_id of its
component, if any; an empty table gives no rows. Grams are 64-bit hashes, classes
64-bit sums over them with the set's size, and neither is compared with its text: among
N different sets some N * N / 2**65 pairs are expected to be taken for one class, that is
one in 4,000 at 10**8 sets and three at 10**10.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bit_filter
from cairn.llm.words import mix, slices, word_hashes
from cairn.operators.graph import components
from cairn.session import cut

WORDS = 5
#: Repeated grams that a task reports of each batch, and that are sent out as frequent, at most.
BATCH_HEAVY, HEAVY = 1 << 16, 1 << 18
#: A gram is frequent from this count on.
HEAVY_COUNT = 8
#: Largest size for which subsets are considered, and what a list entry costs in subsets.
MOST_LIGHT, ENTRY_COST = 24, 8.0
#: Bounds of the bits of a set's parity signature: no two sets differ in fewer grams than their signatures in bits.
SIGN_BITS, MOST_SIGN_BITS = 1 << 10, 1 << 17
#: Classes in a list from which its gram is ranked among the frequent ones.
CROWD = 6
#: Grams that a task counts at once, and entries of lists that a bucket of the distributed count holds about.
STEP_GRAMS, BUCKET_ENTRIES = 1 << 19, 1 << 20
#: Leader rounds go on while pairs across components outnumber list entries by this factor, up to so many rounds.
PAIRS_PER_ENTRY, ROUNDS = 2.0, 6
#: Leaders of a list in a round, in seeded orders; the first round has one more, the entry with fewest rare grams.
LEADERS = 3
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 2, 1 << 64) | 1 for k in range(WORDS)]
#: Slots of 12 bytes in which a task remembers sets to skip copies; a later set takes a slot over.
REMEMBERED = 1 << 19


def gram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    return itertools.chain.from_iterable(itertools.starmap(_gram_sets, slices(texts)))


def _gram_sets(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    ids, edge = word_hashes(raw, ends)
    n = max(0, len(ids) - WORDS + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(WORDS):
        sums += ids[k : k + n] * np.uint64(_FACTORS[k])
    sums, out = mix(sums), []
    for at, upto in itertools.pairwise(edge.tolist()):
        own = upto - at
        if own >= WORDS:
            grams = np.sort(sums[at : upto - WORDS + 1])
            out.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])])
        elif own:
            turned = ids[at:upto] * np.array(_FACTORS[:own], np.uint64)
            out.append(mix(turned.sum(dtype=np.uint64, keepdims=True) + np.uint64(own)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(grams: np.ndarray) -> int:
    """One number of a whole set, whatever its order."""
    return int(mix(grams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).astype(np.int64))


def signature(grams: np.ndarray) -> bytes:
    """Parities of the grams over a power of two of places that grows with the set."""
    bits = min(MOST_SIGN_BITS, max(SIGN_BITS, 1 << len(grams).bit_length()))
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Grams that two sets differ in at least; the longer signature is folded onto the shorter."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _repeated(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    """(1, null, gram, count) of the grams that occur in several of the sets."""
    flat = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]))
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(flat)])
    more = np.flatnonzero(counts > 1)
    if len(more) > BATCH_HEAVY:
        more = more[np.argpartition(counts[more], -BATCH_HEAVY)[-BATCH_HEAVY:]]
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(more), np.int8)), "id": pa.nulls(len(more), id_type), "cls": pa.array(flat[starts[more]].astype(np.int64)), "n": pa.array(counts[more].astype(np.int32))})


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, class, size); kind 1: (null, gram, count in some STEP_GRAMS grams of this task)."""
    held, total, id_type = [], 0, pa.null()
    for b in batches:
        keys, sizes, id_type = [], [], b.column("doc_id").type
        for s in gram_sets(b.column("text")):
            keys.append(class_key(s))
            sizes.append(len(s))
            held.append(s)
            total += len(s)
            if total >= STEP_GRAMS:
                yield _repeated(held, id_type)
                held, total = [], 0
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(keys), np.int8)), "id": b.column("doc_id"), "cls": pa.array(keys, pa.int64()), "n": pa.array(sizes, pa.int32())})
    yield _repeated(held, id_type)


def overlap(s: int, t: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-4 * (s + t) // 9)


def partners(s: int) -> range:
    """Sizes that a set of size s can link with."""
    return range(-(-4 * s // 5), 5 * s // 4 + 1)


def subsets(s: int, boundary: int) -> int:
    """Subsets that a set of size s enumerates."""
    return sum(math.comb(s, overlap(s, t)) for t in partners(s) if min(s, t) <= boundary)


def prefix(s: int) -> int:
    """Leading grams of a set that go into lists."""
    return s - -(-4 * s // 5) + 1


def choose_boundary(histogram: dict[int, int], entry_cost: float = ENTRY_COST) -> int:
    """The size up to which subsets are enumerated, by least total cost.

    histogram: documents of each size up to MOST_LIGHT * 5 / 4; larger sets cost the same for any boundary.
    """
    cost = lambda b: sum(n * (subsets(s, b) + (s > b) * prefix(s) * entry_cost) for s, n in histogram.items())
    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _listed(shared, boundary: int, signed: bool = True):
    """kind 0: (class, size, share of rare grams, prefix, signature); kind 1: (class, size, subset key as two numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = shared.value
        seen, sizes = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int32)
        for raw, ends in (t for b in batches for t in slices(b.column("text"))):
            rows = {k: [] for k in ("kind", "cls", "n", "prio", "key", "other", "side")}
            lists, signs = [], []

            def add(kind, cls, n, prio, key, other, side, tokens, sign=None):
                for k, v in zip(rows, (kind, cls, n, prio, key, other, side), strict=True):
                    rows[k].append(v)
                lists.append(tokens)
                signs.append(sign)

            for own in _gram_sets(raw, ends):
                n, cls = len(own), class_key(own)
                slot = cls % REMEMBERED
                if not n or (seen[slot] == cls and sizes[slot] == n):
                    continue
                seen[slot], sizes[slot] = cls, n
                if n > boundary:
                    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1) if len(grams) else None
                    heavy = np.where(grams[at] == own, counts[at], 0) if at is not None else np.zeros(n, np.int64)
                    order = np.lexsort((own, heavy))[: prefix(n)]
                    rare = int((heavy[order] == 0).sum())
                    add(0, cls, n, rare * 1000 // len(order), 0, 0, 0, own[order].astype(np.int64), signature(own) if signed else None)
                for t in partners(n) if signed and n <= 5 * boundary // 4 + 1 else ():
                    if min(n, t) <= boundary:
                        low, high = min(n, t), max(n, t)
                        for chosen in itertools.combinations(range(n), overlap(n, t)):
                            part = own[list(chosen)] + np.uint64(low * 1000 + high)
                            add(1, cls, n, 0, class_key(part), int(mix(part * np.uint64(3)).sum(dtype=np.uint64).astype(np.int64)), 0 if n == low else 1, None)
                            if low == high:
                                rows["side"][-1] = 2
            if lists:
                types = {"kind": pa.int8(), "cls": pa.int64(), "n": pa.int32(), "prio": pa.int32(), "key": pa.int64(), "other": pa.int64(), "side": pa.int8()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in rows.items()} | {"grams": pa.array(lists, pa.list_(pa.int64())), "sign": pa.array(signs, pa.binary())})

    return run


LISTED = "kind tinyint, cls long, n int, prio int, key long, other long, side tinyint, grams array<long>, sign binary"


def _hashes(column: str | Column) -> list[Column]:
    return [F.xxhash64(column, F.lit(k)) for k in (1, 2)]


def _distinct_counts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _without(b: pa.RecordBatch, grams: np.ndarray) -> pa.RecordBatch:
    """The lists that hold none of the (sorted) grams."""
    return b.filter(pa.array(~_holding(b, grams))) if len(grams) else b


def _holding(b: pa.RecordBatch, grams: np.ndarray) -> np.ndarray:
    flat = b.column("grams").flatten().to_numpy()
    at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
    ends = np.concatenate([[0], np.cumsum(grams[at] == flat)])
    edge = b.column("grams").offsets.to_numpy() - b.column("grams").offsets[0].as_py()
    return ends[edge[1:]] > ends[edge[:-1]]


@dataclass(frozen=True)
class Lists:
    """Listed classes (cls, n, prio, grams): those of the first order without a crowded gram, and the others anew."""

    first: DataFrame
    crowded: Broadcast | None = None
    again: DataFrame | None = None

    def map(self, run, schema: str) -> DataFrame:
        """run(batches) over all lists, whose lists with a crowded gram are passed over in the first order."""
        crowded = self.crowded

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(_without(b, crowded.value) for b in batches) if crowded is not None else run(batches)

        names = ["cls", "n", "prio", "grams"]
        out = self.first.select(*names).mapInArrow(first, schema)
        return out if self.again is None else out.unionByName(self.again.select(*names).mapInArrow(run, schema))


def _bucketed(buckets: int):
    """bucket, grams, counts: each task's distinct grams in sorted runs, a bucket for each range of their values.

    The bytes of a run lie plane by plane, so that the leading ones compress away.
    """

    def rows(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        number = (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edge = np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))
        there = np.flatnonzero(np.diff(edge))
        planes = [grams[edge[k] : edge[k + 1]].view(np.uint8).reshape(-1, 8).T.tobytes() for k in there]
        sums = [counts[edge[k] : edge[k + 1]].astype("<u4").tobytes() for k in there]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32()), "grams": pa.array(planes, pa.binary()), "counts": pa.array(sums, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            held.append(b.column("grams").flatten().to_numpy().view(np.uint64).copy())
            total += len(held[-1])
            if total >= STEP_GRAMS:
                flat = np.concatenate(held)
                yield rows(*_distinct_counts(flat, np.ones(len(flat), np.int64)))
                held, total = [], 0
        if total:
            flat = np.concatenate(held)
            yield rows(*_distinct_counts(flat, np.ones(len(flat), np.int64)))

    return run


def _bucket_total(table: pa.Table) -> pa.Table:
    """gram, k of a bucket's grams that occur more than once."""
    blobs = [x.as_buffer() for x in table.column("grams")]
    grams = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.reshape(-1).view(np.uint64) for x in blobs])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")]).astype(np.int64)
    grams, counts = _distinct_counts(grams, counts)
    more = counts > 1
    return pa.table({"gram": pa.array(grams[more].view(np.int64)), "k": pa.array(counts[more])})


def shared_grams(spark: SparkSession, lists: Lists, entries: int) -> DataFrame:
    """gram, k of the lists with more than one entry; a class that two tasks met counts twice.

    Tasks send sorted runs of their grams to buckets of some BUCKET_ENTRIES, where
    equal grams meet; how many buckets there are follows from the number of entries.
    """
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // BUCKET_ENTRIES)
    runs = lists.map(_bucketed(buckets), "bucket int, grams binary, counts binary")
    return cut(runs.groupBy("bucket").applyInArrow(_bucket_total, "gram long, k long"), "shared_grams")


def list_entries(lists: Lists, shared: DataFrame) -> DataFrame:
    """gram, cls, n, pos, prio of the lists with more than one class."""
    words = shared.sparkSession.sparkContext.broadcast(bit_filter.build(shared, F.col("gram"), F.shiftleft("gram", bit_filter.BITS)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("grams").flatten().to_numpy()
            sizes = np.diff(b.column("grams").offsets.to_numpy())
            at = np.flatnonzero(bit_filter.maybe(words.value, grams, grams << bit_filter.BITS))
            row = np.repeat(np.arange(len(b)), sizes)[at]
            pos = at - (np.cumsum(sizes) - sizes)[row]
            own = {c: b.column(c).take(pa.array(row)) for c in ("cls", "n", "prio")}
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams[at]), "cls": own["cls"], "n": own["n"], "pos": pa.array(pos.astype(np.int32)), "prio": own["prio"]})

    some = lists.map(kept, "gram long, cls long, n int, pos int, prio int")
    return cut(some.join(shared.select("gram"), "gram", "left_semi").distinct(), "entries")


def chosen(docs: DataFrame, wanted: DataFrame, text: str, doc_id: Column, run, schema: str) -> DataFrame:
    """run over the (id, text) batches of documents that are, or by a filter may be, wanted's rep."""
    words = docs.sparkSession.sparkContext.broadcast(bit_filter.build(wanted.where("rep is not null"), *_hashes("rep")))
    nulls = bool(wanted.where("rep is null").take(1))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = bit_filter.maybe(words.value, b.column("h1").to_numpy(), b.column("h2").to_numpy())
            keep |= nulls & b.column("id").is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(keep))

    rows = docs.select(doc_id.alias("id"), F.col(text).alias("text"), F.xxhash64(doc_id, F.lit(1)).alias("h1"), F.xxhash64(doc_id, F.lit(2)).alias("h2")).where("text is not null")
    return rows.mapInArrow(lambda batches: run(kept(batches)), schema)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for raw, ends in (t for b in batches for t in slices(b.column("text"))):
        sets = _gram_sets(raw, ends)
        yield pa.RecordBatch.from_pydict({"cls": pa.array([class_key(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})


def class_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: Column) -> DataFrame:
    """cls, grams (sorted, packed) of the wanted (rep, cls, n)."""
    found = chosen(docs, wanted, text, doc_id, _whole_sets, "cls long, n int, grams binary")
    return cut(found.join(wanted, ["cls", "n"], "left_semi").dropDuplicates(["cls"]).select("cls", "grams"), "class_sets")


def relisted(docs: DataFrame, lists: DataFrame, crowded: np.ndarray, counts: np.ndarray, heavy, classes: DataFrame, boundary: int, text: str, doc_id: Column) -> Lists:
    """The lists after crowded grams were ranked among the frequent.

    Only classes with a crowded gram in their prefix change: without one, the rarer
    grams that make up a prefix are the same in both orders.
    """
    order = np.argsort(crowded)
    where = lists.sparkSession.sparkContext
    grams = where.broadcast(crowded[order])

    def changing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_holding(b, grams.value))).select(["cls", "n"])

    changed = cut(lists.select("cls", "n", "grams").mapInArrow(changing, "cls long, n int").distinct(), "changed")
    wanted = cut(classes.join(changed, ["cls", "n"], "left_semi").select("rep", "cls", "n"), "wanted")
    every = np.concatenate([heavy[0], crowded[order].view(np.uint64)])
    found, first = np.unique(every, return_index=True)
    shared = where.broadcast((found, np.concatenate([heavy[1], counts[order]])[first]))
    again = chosen(docs, wanted, text, doc_id, _listed(shared, boundary, False), LISTED).where("kind = 0").drop("sign")
    return Lists(lists, grams, cut(again.join(changed, ["cls", "n"], "left_semi"), "relisted"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures do not rule a link out, which needs at most (n + m) / 9 grams on one side only."""
    for b in batches:
        sizes = (b.column("n").to_numpy().astype(np.int64) + b.column("m").to_numpy()).tolist()
        far = [apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
        keep = pa.array([9 * d <= s for d, s in zip(far, sizes, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "far": pa.array([d / s for d, s in zip(far, sizes, strict=True)], pa.float64())}).filter(keep)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link by their whole sets."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Verifier:
    """Decides pairs of classes; whole sets are fetched once, for pairs that signatures leave open."""

    def __init__(self, docs: DataFrame, classes: DataFrame, signs: DataFrame, text: str, doc_id: Column):
        self.docs, self.classes, self.signs, self.text, self.doc_id = docs, classes, signs, text, doc_id
        self.sets: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """a, b, far of the pairs that signatures leave open."""
        x, y = (self.signs.select(F.col("cls").alias(k), F.col("sign").alias(v), F.col("n").alias(m)) for k, v, m in (("a", "x", "n"), ("b", "y", "m")))
        return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_near, "a long, b long, far double"), "near_pairs")

    def linked(self, near: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        wanted = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = cut(self.classes.join(wanted, "cls", "left_semi").select("rep", "cls", "n"), "wanted")
        if wanted.take(1):
            more = class_sets(self.docs, wanted, self.text, self.doc_id)
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return near.select("a", "b")
        x, y = (self.sets.select(F.col("cls").alias(k), F.col("grams").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return cut(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), "links")


def _possible(p: str, q: str) -> Column:
    """Size, position and prefix conditions on entries p and q of one list."""
    n, m, i, j = (F.col(c) for c in (f"{p}.n", f"{q}.n", f"{p}.pos", f"{q}.pos"))
    short = lambda size, pos: pos < size - F.ceil(size * 8 / 9) + 1
    sizes = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    room = 9 * (1 + F.least(n - i - 1, m - j - 1)) >= 4 * (n + m)
    return sizes & room & F.when(n < m, short(n, i)).when(m < n, short(m, j)).otherwise(short(n, i) | short(m, j))


def _pair(p: str, q: str) -> list[Column]:
    return [F.least(f"{p}.cls", f"{q}.cls").alias("a"), F.greatest(f"{p}.cls", f"{q}.cls").alias("b")]


def leader_pairs(entries: DataFrame, orders: list[Column], leads: Column, others: Column) -> DataFrame:
    """Each list's other entries with its leaders, the least in each of the given orders."""
    least = [F.min(F.struct(o.alias("o"), F.xxhash64("cls").alias("h"), "cls", "n", "pos")).alias(f"l{k}") for k, o in enumerate(orders)]
    bare = F.array_distinct(F.array(*(F.struct(*(F.col(f"l{k}.{c}").alias(c) for c in ("cls", "n", "pos"))) for k in range(len(orders)))))
    lead = entries.where(leads).groupBy("gram").agg(*least).select("gram", F.inline(bare))
    q = cut(lead, "leaders").alias("q")
    p = entries.where(others).alias("p")
    return p.join(q, (F.col("p.gram") == F.col("q.gram")) & (F.col("p.cls") != F.col("q.cls")) & _possible("p", "q")).select(*_pair("p", "q")).distinct()


def spanning(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries of lists of more than two classes that span several components, with comp and the list's main component."""
    e, c = entries.alias("e"), comps.alias("c")
    held = cut(e.join(c, F.col("e.cls") == F.col("c.node"), "left").select("e.*", F.coalesce("c.comp", "e.cls").alias("comp")), "by_component")
    per = held.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    per = per.groupBy("gram").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")).where("comps > 1 and all > 2")
    mixed = cut(per.select("gram", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.k")).alias("rest"), "all"), "mixed")
    return cut(held.join(mixed, "gram"), "spanning")


def _seeded(number: int) -> list[Column]:
    """Orders of a round's leaders."""
    return [F.xxhash64("cls", F.lit(number * LEADERS + k)) for k in range(LEADERS)]


def across_pairs(mixed: DataFrame) -> DataFrame:
    """Every possible pair of a list whose classes are in different components.

    Besides the gram a pair shares its class of size, in steps of a quarter, or has
    neighbouring ones: of a long list only members of like size meet.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int")
    q = mixed.withColumn("like", step).alias("q")
    p = mixed.where("comp <> main").withColumn("like", F.explode(F.array(step - 1, step, step + 1))).alias("p")
    other = (F.col("p.comp") != F.col("q.comp")) & ((F.col("q.comp") == F.col("q.main")) | (F.col("p.cls") < F.col("q.cls")))
    return p.join(q, (F.col("p.gram") == F.col("q.gram")) & (F.col("p.like") == F.col("q.like")) & other & _possible("p", "q")).select(*_pair("p", "q")).distinct()


def heavy_links(entries: DataFrame, verifier: Verifier) -> DataFrame:
    """Links that connect whatever links connect among the classes of the lists.

    The first round decides every list of two. Rounds go on while lists with more
    span components and there is more to pair up than entries; a list that no longer
    spans any is left behind.
    """
    edges, last = verifier.linked(verifier.near(leader_pairs(entries, [F.col("prio")], F.lit(True), F.lit(True)))), None
    mixed = entries
    for number in range(1, ROUNDS + 1):
        mixed = spanning(mixed.select(entries.columns), components(edges))
        work, n = mixed.agg(F.sum(F.when(F.col("comp") != F.col("main"), F.col("all"))), F.count("*")).first()
        if not n:
            return edges
        if work <= PAIRS_PER_ENTRY * n or last and 2 * work > last or number == ROUNDS:
            break
        last = work
        more = leader_pairs(mixed, _seeded(number), F.expr("comp = main"), F.expr("comp <> main"))
        edges = edges.unionByName(verifier.linked(verifier.near(more)))
    return edges.unionByName(verifier.linked(verifier.near(across_pairs(mixed))))


def light_links(subs: DataFrame) -> DataFrame:
    """Stars over shared subsets: each class with the least of the other side."""
    key = ["key", "other"]
    least = subs.groupBy(*key).agg(F.min(F.when(F.col("side") != 1, F.col("cls"))).alias("low"), F.min(F.when(F.col("side") != 0, F.col("cls"))).alias("high"))
    least = cut(least.where("low is not null and high is not null"), "stars")
    other = F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low"))
    return subs.join(least, key).select(F.col("cls").alias("a"), other.alias("b")).where("a <> b").distinct()


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str | Column = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row.

    class_id and component_id are the least doc_id of the same set and of all that
    links reach. doc_id names a column of whole numbers or is an expression of any
    type that has an order.
    """
    spark: SparkSession = docs.sparkSession
    doc_id = F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    seen = cut(rows.mapInArrow(_described, f"kind tinyint, id {id_type}, cls long, n int"), "sets")
    held = seen.where("kind = 0")
    heavy = seen.where("kind = 1").groupBy(F.col("cls").alias("gram")).agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_COUNT)
    top = heavy.orderBy(F.desc("n"), "gram").limit(HEAVY).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    small = held.where((F.col("n") > 0) & (F.col("n") <= MOST_LIGHT * 5 // 4)).groupBy("n").agg(F.count("*").alias("k")).collect()
    boundary = choose_boundary({r.n: r.k for r in small})
    frequent = (grams[order], top["n"].to_numpy(np.int64)[order])
    listed = cut(rows.mapInArrow(_listed(spark.sparkContext.broadcast(frequent), boundary), LISTED), "listed")
    classes = cut(held.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("rep"), F.count("*").alias("k")), "classes")
    first = listed.where("kind = 0").select("cls", "n", "prio", "grams", "sign")
    lists = Lists(first)
    sizes = held.where("n > 0").groupBy("n").agg(F.count("*").alias("k"))
    entries = sizes.agg(F.sum(F.expr("k * (n - ceil(4 * n / 5) + 1)"))).first()[0] or 0
    shared = shared_grams(spark, lists, entries)
    crowd = shared.where(F.col("k") > CROWD).orderBy(F.desc("k"), "gram").limit(HEAVY).toPandas()
    if len(crowd):
        lists = relisted(docs, first, crowd["gram"].to_numpy(np.int64), crowd["k"].to_numpy(np.int64), frequent, classes, boundary, text, doc_id)
        shared = shared_grams(spark, lists, entries)
    entries = list_entries(lists, shared)
    signs = first.select("cls", "n", "sign").join(entries.select("cls").distinct(), "cls", "left_semi")
    verifier = Verifier(docs, classes, cut(signs.dropDuplicates(["cls"]), "signatures"), text, doc_id)
    edges = heavy_links(entries, verifier).unionByName(light_links(listed.where("kind = 1")))
    comps = cut(components(edges), "components")
    joint = comps.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    roots = cut(joint.groupBy("comp").agg(F.min("rep").alias("root")), "roots")
    by_class = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(roots, "comp", "left")
    by_class = cut(by_class.where("k > 1 or root is not null").select("cls", "n", "rep", F.coalesce("root", "rep").alias("root")), "roots")
    out = held.alias("d").join(by_class.alias("c"), (F.col("d.cls") == F.col("c.cls")) & (F.col("d.n") == F.col("c.n")), "left")
    own = lambda c: F.coalesce(c, "d.id")
    return out.select(F.col("d.id").alias("doc_id"), F.col("d.n").cast("long").alias("n_shingles"), own("c.rep").alias("class_id"), own("c.root").alias("component_id"))
