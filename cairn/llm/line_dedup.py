"""Line dedup by winnowing, in DataFrame operations only.

A run is a stretch of lines with words that has at least MIN_LINES lines or
MIN_WORDS words. Every shortest stretch that makes a run (at most MIN_LINES lines) is
a window; its least line hash is selected as fingerprint, so equal runs always share
a selected fingerprint. Fingerprints at one position only are dropped; the positions of
the others are joined by their window's content, each with the first of its kind. A
match is extended both ways along its diagonal (one document, one earlier document,
one distance between their lines) to its maximal length, and the lines of the later
side are deleted. A line is deleted exactly when it lies in a run that occurs earlier, in
the order of doc_id, then line.

Defined cases: lines end at \\n only and are compared unchanged; lines without a word
are neither counted nor deleted; a null text stays null and has no lines; rows that
repeat both doc_id and text are one document; a row with a null doc_id is left
alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut

MIN_LINES, MIN_WORDS = 3, 50
#: Bits of the filters that keep rows without a partner from being shuffled, as a power of two: 262,144 words at most.
FILTER_BITS = 24
WORD = r"[^\\x20\\x09-\\x0D]+"


def windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark, q, m, first, last, at, anchor, k1, k2 of every window of (doc_id, mark, text).

    q counts lines with words, first and last all lines; k1 and k2 hash the content.
    """
    rows = docs.where("text is not null and doc_id is not null").selectExpr("doc_id", "mark", f"filter(transform(split(text, '\\n'), (l, i) -> struct(i, xxhash64(l) as h, xxhash64(l, 7) as g, regexp_count(l, '{WORD}') as w)), x -> x.w > 0) as lines")
    # a short table of counts first: most documents have fewer lines than a window
    rows = rows.where("size(lines) > 0")
    made = []
    for m in range(1, min_lines + 1):
        at = [f"get(lines, q + {k})" if k else "get(lines, q)" for k in range(m)]
        enough = f"q + {m} <= size(lines)" + ("" if m == min_lines else f" and {' + '.join(f'{x}.w' for x in at)} >= {min_words}")
        least = f"least({', '.join(f'{x}.h' for x in at)})" if m > 1 else f"{at[0]}.h"
        place = " ".join(f"when {at[k]}.h = {least} then q + {k}" for k in reversed(range(m)))
        made.append(f"case when {enough} then struct(q, {m} as m, {at[0]}.i as first, {at[-1]}.i as last, case {place} end as at, {least} as anchor, xxhash64({', '.join(f'{x}.h' for x in at)}) as k1, xxhash64({m}, {', '.join(f'{x}.g' for x in at)}) as k2) end")
    every = f"flatten(transform(sequence(0, size(lines) - 1), q -> filter(array({', '.join(made)}), w -> w is not null)))"
    return rows.selectExpr("doc_id", "mark", f"inline({every})")


def _bit(key: Column) -> Column:
    return F.shiftright(key, 64 - FILTER_BITS).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def marked(rows: DataFrame, key: Column, held: DataFrame) -> DataFrame:
    """rows plus maybe: false where the 64-bit key is surely none of held.key.

    The filter is a broadcast table of 64-bit words, of fixed size whatever it holds; one
    that is full rules nothing out, and the exact join that follows decides.
    """
    bits = held.select(_bit(F.col("key")).alias("p")).selectExpr("shiftright(p, 6) as word", "shiftleft(1L, cast(p & 63 as int)) as bit")
    words = cut(bits.groupBy("word").agg(F.bit_or("bit").alias("word_bits")), "filter")
    found = rows.withColumn("p", _bit(key)).join(F.broadcast(words), F.shiftright("p", 6) == F.col("word"), "left")
    return found.withColumn("maybe", F.coalesce(F.expr("getbit(word_bits, cast(p & 63 as int)) = 1"), F.lit(False))).drop("p", "word", "word_bits")


def repeated_windows(found: DataFrame) -> DataFrame:
    """doc_id, mark, q, m, first, last and lead (doc_id, mark, q) of the windows whose content occurs earlier."""
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("mark").alias("m0"), F.max("mark").alias("m1"), F.min("at").alias("a0"), F.max("at").alias("a1"))
    anchors = cut(anchors.where("d0 <> d1 or m0 <> m1 or a0 <> a1").select("anchor"), "anchors")
    near = marked(found, F.col("anchor"), anchors.withColumnRenamed("anchor", "key")).where("maybe").drop("maybe")
    near = cut(near.join(anchors, "anchor", "left_semi"), "near")
    lead = near.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "q")).alias("lead"))
    lead = cut(lead.where("n > 1").drop("n"), "first_windows")
    later = near.join(lead, ["k1", "k2"]).where(F.struct("doc_id", "mark", "q") != F.col("lead"))
    return later.select("doc_id", "mark", "q", "m", "first", "last", "lead")


def _joined(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, first, last of stretches a .. b, those that overlap or touch being one."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("new", F.when(before >= F.col("a"), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def matches(later: DataFrame) -> DataFrame:
    """doc_id, mark, lead_doc, lead_mark, shift, a, b, first, last: maximal stretches equal to lines shift earlier of the lead.

    Windows of a diagonal that overlap or touch carry the match on, to either side.
    """
    keys = ["doc_id", "mark", "lead_doc", "lead_mark", "shift"]
    rows = later.select("doc_id", "mark", F.col("lead.doc_id").alias("lead_doc"), F.col("lead.mark").alias("lead_mark"), (F.col("q") - F.col("lead.q")).alias("shift"), F.col("q").alias("a"), (F.col("q") + F.col("m")).alias("b"), "first", "last")
    once = rows.groupBy(*keys, "a").agg(F.max("b").alias("b"), F.min("first").alias("first"), F.max("last").alias("last"))
    return _joined(once.repartition("doc_id", "mark"), keys)


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row's doc_id, clean text, n_lines, n_removed and deleted runs (a:b of lines with words)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = cut(windows(rows, min_lines, min_words), "windows")
    runs = _joined(matches(repeated_windows(found)), ["doc_id", "mark"])
    runs = runs.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("a", "b", "first", "last"))).alias("runs"))
    runs = cut(runs, "runs")
    key = F.xxhash64("doc_id", "mark")
    # texts without a run stay where they are; only the others travel to their runs
    told = marked(rows, key, runs.select(key.alias("key")))
    d, r = told.where("maybe").alias("d"), runs.alias("r")
    out = d.join(r, (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("d.mark") == F.col("r.mark")), "left").select("d.doc_id", "d.text", "r.runs")
    out = out.unionByName(told.where("not maybe").select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")))
    out = out.withColumn("lines", F.split("text", "\n"))
    has_word = "l rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
    # between runs lines stay, inside them those without a word
    after = "slice(lines, r.last + 2, coalesce(get(runs, i + 1).first, size(lines)) - r.last - 1)"
    parts = f"flatten(transform(runs, (r, i) -> array(filter(slice(lines, r.first + 1, r.last - r.first + 1), l -> not ({has_word})), {after})))"
    clean = f"case when runs is null then text else array_join(flatten(concat(array(slice(lines, 1, runs[0].first)), {parts})), '\n') end"
    n_lines = f"cast(case when text is null then 0 else size(filter(lines, l -> {has_word})) end as bigint)"
    removed = "cast(case when runs is null then 0 else aggregate(runs, 0, (s, r) -> s + r.b - r.a) end as bigint)"
    spans = "case when runs is null then '' else array_join(transform(runs, r -> concat_ws(':', cast(r.a as string), cast(r.b as string))), ',') end"
    return out.selectExpr("doc_id", f"{clean} as text", f"{n_lines} as n_lines", f"{removed} as n_removed", f"{spans} as runs")


SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS q, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT *, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3, lead(w, 1) OVER o AS w2 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
win AS (SELECT doc_id, q, 1 AS m, line AS c FROM x WHERE w >= 50
        UNION ALL SELECT doc_id, q, 2, line || chr(10) || l2 FROM x WHERE l2 IS NOT NULL AND w + w2 >= 50
        UNION ALL SELECT doc_id, q, 3, line || chr(10) || l2 || chr(10) || l3 FROM x WHERE l3 IS NOT NULL),
rep AS (SELECT doc_id, q, m FROM (SELECT *, row_number() OVER (PARTITION BY m, c ORDER BY doc_id, q) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(q, q + m)) AS q FROM rep),
isl AS (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS g FROM gone),
runs AS (SELECT doc_id, min(q) AS a, max(q) + 1 AS b FROM isl GROUP BY doc_id, g),
r AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS runs, sum(b - a) AS n_removed FROM runs GROUP BY doc_id),
keep AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS clean FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.i = n.i
         LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.q = gone.q WHERE gone.q IS NULL GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, coalesce(r.runs, '') AS runs, sha256(coalesce(keep.clean, '')) AS text_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN keep ON d.doc_id = keep.doc_id"""
