"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by weight; a source whose share exceeds
its cap (maximum epochs times its size) is clamped there and the excess is dealt
out again by weight among the others until none is above. A source is then taken
in whole repetitions of all its documents plus a fractional one: documents in a
seeded order while their midpoints fall below what is missing.

Defined cases: a null text has size 0; a null source is a source of its own, last
in the order; rows that repeat a doc_id, or have none, are documents of their own; a source of
size 0 takes nothing; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Leading hex digits of the seeded order that form a block of the prefix sums.
BLOCK_DIGITS = 3
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    """Runs of other characters than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, total: float | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight -> + target, by water-filling.

    Each round is one aggregate of two numbers: what the clamped sources hold and
    what the others weigh. Rounds end when no source is newly clamped.
    """
    rows = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    if total is None:
        total = rows.agg(F.sum("source_size")).first()[0] or 0
    budget, level, clamped = total * share, 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        held, weight, n = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, max(0.0, (budget - held) / weight)
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)) if weight else F.col("cap")).drop("cap")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str | Column = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row.

    Weights go to sources in code-point order, repeating. The seeded order is by the
    MD5 of seed, doc_id and text; its prefix sums are split by hash blocks, so that no
    task holds a whole source. doc_id may be an expression of any type.
    """
    doc_id = F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(doc_id.alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), rank.alias("rank"))
    rows = cut(rows.withColumn("block", F.substring("rank", 1, BLOCK_DIGITS)), "sizes")
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    named = blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    targets = cut(fill_targets(cut(named.withColumn("weight", weight), "sources"), None, share, max_epochs), "targets")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("block_size").over(before), F.lit(0)))
    b, t = blocks.alias("b"), targets.alias("t")
    blocks = cut(b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.block", "b.start", "t.source_size", "t.target"), "block_starts")
    r, b = rows.alias("r"), blocks.alias("b")
    joined = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block"))).select("r.*", "b.start", "b.source_size", "b.target")
    order = Window.partitionBy("source", "block").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    missing = F.col("target") - whole * F.col("source_size")
    copies = whole + F.when(F.col("ahead") + F.col("size") / 2 < missing, 1).otherwise(0)
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def sql(table: str = "documents", seed: str = SEED) -> str:
    """The same mix in DuckDB, its rounds unrolled by a recursive table."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS rank FROM {table}),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 2e0 * source_size AS cap FROM s0),
lv(i, level) AS (
  SELECT 0, 0e0
  UNION ALL
  SELECT i + 1, (SELECT ((SELECT sum(source_size) FROM s) * 15e-1 - coalesce(sum(CASE WHEN cap <= weight * level THEN cap ELSE 0e0 END), 0e0))
                        / nullif(sum(CASE WHEN cap <= weight * level THEN 0e0 ELSE weight END), 0e0) FROM s)
  FROM lv WHERE i < 60),
last AS (SELECT level FROM lv WHERE i = 60),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM s, last),
o AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)
         + CASE WHEN ahead + size / 2e0 < target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o"""
