"""How far the sources of a language differ in the words they use.

Terms are counted for each language and source where the texts lie, and the counts of
one term over the sources of its language are its sparse vector. Most vectors repeat:
terms of one vector form one class with a multiplicity. The divergence of two sources is
the sum over all kept terms of floor((p-q)^2/q), p and q being whole billionths, and is
evaluated once for each class:

    f(p,q) over both = [f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)]   classes that hold both
                     + [f(p,q0) - f(p0,q0)]                      counts of the first source
                     + [f(p0,q) - f(p0,q0)]                      counts of the second source
                     + V * f(p0,q0)

where p0 and q0 are what a term without occurrence has. So a class only ever makes the
pairs that it holds, and a source without the term costs nothing; the second and third
lines go over the distinct counts of a source and the distinct values of q0. All sums are
of whole numbers and exact.

Defined cases: null text, lang and source count as empty strings; a group without terms
and a language without kept terms keep their rows in the pair part (value 0 if nothing is
kept); a language with one source has no pairs; rows that repeat a document count again,
as documents of their own; an empty table gives no rows; other columns are not read.

The result holds a row for each pair of sources of a language, so a language's sources
are taken to be few enough for that: their names and sizes are one row of arrays.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.terms import LETTERS, blocks, texts
from cairn.session import cut

LEAST_DOCS, TOP = 3, 200
#: Shares are counted in this part of one.
UNIT = 1_000_000_000
#: Terms that a task holds before it hands its counts on.
HELD = 1 << 18
COUNTS = "lang string, source string, term string, n long, docs long"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, summed over what comes together."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = lambda v: pa.array([v], pa.string()).take(pa.array([0] * len(terms), pa.int32()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts(b.column("text")), strict=True):
            n, docs = held[lang, source]
            before, own = len(n), set()
            for block in blocks(text, LETTERS):
                words = Counter(block.split())
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def share(n: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / size), size being N + V; exact for any count of 18 digits."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, size.cast("decimal(19,0)")) + F.lit(1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares, which are 1 to UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def times(value: Column, n: Column) -> Column:
    return value.cast("decimal(19,0)") * n.cast("decimal(19,0)")


def count_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term in every group that has it."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(_tally, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered_groups(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, at: every group that occurs, its place among the sources of its language."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")))


def kept_terms(counts: DataFrame, groups: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n, vector: the terms in enough documents of their language, with their counts by place of the source."""
    rows = counts.join(groups, ["lang", "source"])
    vector = F.array_sort(F.collect_list(F.struct("at", F.col("n").alias("n")))).alias("vector")  # an entry a source at most
    out = rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector)
    return out.where(F.col("docs") >= least).select("lang", "term", F.col("total").alias("n"), "vector")


def sized_groups(groups: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups plus size, N + V; and a row a language: kept (V), lang_size (its own N + V), sources, sizes and what a term without occurrence has, by place."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("n"))
    own = terms.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.at").agg(F.sum("e.n").alias("n"))
    sized = groups.join(own, ["lang", "at"], "left").join(langs.select("lang", "kept"), "lang", "left")
    sized = sized.select("lang", "source", "at", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("n", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("size"))
    sized = cut(sized, "groups")
    without = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("size"))).otherwise(F.lit(1).cast("long"))
    held = F.array_sort(F.collect_list(F.struct("at", "source", "size", without.alias("p0")))).alias("held")
    by_lang = sized.groupBy("lang").agg(F.max("kept").alias("kept"), held).join(langs.select("lang", (F.col("n") + F.col("kept")).alias("lang_size")), "lang", "left")
    by_lang = by_lang.select("lang", "kept", "lang_size", *(F.col(f"held.{c}").alias(n) for c, n in (("source", "sources"), ("size", "sizes"), ("p0", "nothing"))))
    return sized, cut(by_lang, "langs")


def pair_divergence(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, a, b, value for every ordered pair of places of a language."""
    classes = cut(terms.groupBy("lang", "vector").agg(F.count("*").alias("alike")).join(langs, "lang"), "classes")
    shares = F.transform("vector", lambda e: F.struct(e["at"].alias("at"), share(e["n"], F.element_at("sizes", e["at"])).alias("p"), F.element_at("nothing", e["at"]).alias("p0")))
    known = classes.select("lang", "alike", shares.alias("vector"))
    both = known.select("lang", "alike", "vector", F.explode("vector").alias("a")).select("lang", "alike", "a", F.explode("vector").alias("b")).where("a.at <> b.at")
    p, p0, q, q0 = (F.col(c) for c in ("a.p", "a.p0", "b.p", "b.p0"))
    held = gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    both = both.groupBy("lang", F.col("a.at").alias("a"), F.col("b.at").alias("b")).agg(F.sum(times(held, F.col("alike"))).alias("v"))
    # how often a source has each share, against each share that another gives to nothing
    alone = known.select("lang", "alike", F.explode("vector").alias("a")).groupBy("lang", "a.at", "a.p", "a.p0").agg(F.sum("alike").alias("alike"))
    alone = alone.join(langs.select("lang", F.explode(F.array_distinct("nothing")).alias("q0")), "lang")
    q0 = F.col("q0")
    alone = alone.groupBy("lang", "at", "q0").agg(F.sum(times(gap(F.col("p"), q0) - gap(F.col("p0"), q0), F.col("alike"))).alias("first"), F.sum(times(gap(q0, F.col("p")) - gap(q0, F.col("p0")), F.col("alike"))).alias("second"))
    alone = cut(alone, "alone")
    pairs = langs.select("lang", "kept", "nothing", F.posexplode("nothing").alias("a", "p0")).select("lang", "kept", "a", "p0", F.posexplode("nothing").alias("b", "q0"))
    pairs = pairs.withColumns({"a": F.col("a") + 1, "b": F.col("b") + 1}).where("a <> b")
    pairs = pairs.join(both, ["lang", "a", "b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("at").alias("a"), "q0", "first"), ["lang", "a", "q0"], "left")
    pairs = pairs.join(alone.select("lang", F.col("at").alias("b"), F.col("q0").alias("p0"), "second"), ["lang", "b", "p0"], "left")
    none = F.lit(0).cast("decimal(38,0)")
    value = times(gap(F.col("p0"), F.col("q0")), F.col("kept")) + F.coalesce("v", none) + F.coalesce("first", none) + F.coalesce("second", none)
    return pairs.select("lang", "a", "b", value.cast("long").alias("value"))


def overused_terms(terms: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, at, item, value, rank: the terms that a source uses more than its language, the most telling first."""
    rows = terms.join(langs.select("lang", "lang_size", "sizes"), "lang").select("lang", "term", share(F.col("n"), F.col("lang_size")).alias("q"), "sizes", F.explode("vector").alias("e"))
    rows = rows.select("lang", "e.at", F.col("term").alias("item"), share(F.col("e.n"), F.element_at("sizes", F.col("e.at"))).alias("p"), "q").where("p > q")
    rows = rows.select("lang", "at", "item", gap(F.col("p"), F.col("q")).alias("value"))
    # each task hands on its own first `top` of a group only
    order = Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups = cut(numbered_groups(docs, lang, source), "numbered")
    terms = cut(kept_terms(count_terms(docs, lang, source, text), groups, least), "terms")
    sized, langs = sized_groups(groups, terms)
    names = sized.select("lang", "at", "source")
    pairs = pair_divergence(terms, langs).join(names.select("lang", F.col("at").alias("a"), "source"), ["lang", "a"]).join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    words = overused_terms(terms, langs, top).join(names, ["lang", "at"])
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(words, "term"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY o.lang, o.source, o.term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS p, 1 + ({UNIT}::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p-b.p)*(a.p-b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p-q)*(p-q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}"""
