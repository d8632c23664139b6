"""Annotation sets: subsets, identifiers, extra coordinates, scale bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.columns import dist3
from cairn.operators.grids import seeded

#: Fixed values of the reference survey's scale bars: target, target, metres.
SCALEBARS = [
    ("target 3", "target 4", 0.500), ("target 5", "target 6", 0.500), ("target 7", "target 8", 0.499),
    ("target 31", "target 33", 0.20), ("target 32", "target 34", 0.20), ("target 31", "target 32", 0.07), ("target 33", "target 34", 0.07),
    ("target 35", "target 37", 0.20), ("target 36", "target 38", 0.20), ("target 35", "target 36", 0.07), ("target 37", "target 38", 0.07),
    ("target 39", "target 41", 0.20), ("target 40", "target 42", 0.20), ("target 39", "target 40", 0.07), ("target 41", "target 42", 0.07),
    ("target 43", "target 45", 0.20), ("target 44", "target 46", 0.20), ("target 43", "target 44", 0.07), ("target 45", "target 46", 0.07),
]


def by_prefix(rows: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    return rows.where(F.col(column).startswith(prefix))


def by_label(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col("label") == label)


def with_match(rows: DataFrame, column: str = "cam_id") -> DataFrame:
    """Those that have an image match, in order of id."""
    return rows.where(F.col(column).isNotNull()).orderBy("id")


def first(rows: DataFrame, n: int) -> DataFrame:
    """The first n by position."""
    return rows.orderBy("pos").limit(n)


def by_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions start .. stop - 1 in order, as a slice; negative ones count from the end."""
    if start < 0 or stop < 0:
        n = rows.count()
        start, stop = (max(0, k + n) if k < 0 else k for k in (start, stop))
    return rows.orderBy("pos").offset(start).limit(max(0, stop - start))


def random_subset(rows: DataFrame, n: int, seed: str = "1", key: str = "id") -> DataFrame:
    """n rows in seeded order; an error if there are fewer."""
    have = rows.limit(n).count()
    if have < n:
        raise ValueError(f"a sample of {n} from {have} rows")
    return rows.withColumn("h", seeded(key, seed=seed)).orderBy("h", key).limit(n).drop("h")


def from_coords(spark: SparkSession, coords: dict | list) -> DataFrame:
    """Annotations (id, pos, x, y, z) of a dict or list of coordinates; an entry that is None is left out but keeps its place."""
    pairs = coords.items() if isinstance(coords, dict) else enumerate(coords)
    rows = [(str(k), i, *map(float, c)) for i, (k, c) in enumerate(pairs) if c is not None]
    return spark.createDataFrame(rows, "id string, pos long, x double, y double, z double")


def next_id(rows: DataFrame, last: int = 0, default: str = "ann_") -> DataFrame:
    """The id after the greatest trailing number, with that id's prefix and width."""
    digits = F.regexp_extract("id", r"(\d+)$", 1)
    found = rows.where(digits != "").select(digits.alias("digits"), F.expr("substring(id, 1, length(id) - length(regexp_extract(id, '(\\\\d+)$', 1)))").alias("prefix"))
    best = found.agg(F.max(F.struct(F.col("digits").cast("long").alias("n"), "prefix", F.length("digits").alias("w"))).alias("b"))
    number = F.greatest(F.coalesce("b.n", F.lit(0)), F.lit(last)) + 1
    width = F.greatest(F.coalesce("b.w", F.lit(4)), F.length(number.cast("string")))
    return best.select(F.concat(F.coalesce("b.prefix", F.lit(default)), F.lpad(number.cast("string"), width, "0")).alias("next_id"))


def append(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """The union; an id in both is an error when the result is read."""
    rows = a.unionByName(b)
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key))).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def stripped(column: Column) -> Column:
    """An id without its side suffixes."""
    return F.replace(F.replace(column, F.lit("_left"), F.lit("")), F.lit("_right"), F.lit(""))


def split_extra(rows: DataFrame) -> DataFrame:
    """rows (id, pos, ..) plus own_id and is_extra: a suffixed row is extra when its bare id came before it."""
    rows = rows.withColumn("bare", stripped(F.col("id")))
    before = Window.partitionBy("bare").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col("id") == F.col("bare"), 1).otherwise(0)).over(before), F.lit(0)) == 1
    return rows.withColumn("is_extra", seen).withColumn("own_id", F.when(F.col("is_extra"), F.col("bare")).otherwise(F.col("id"))).drop("bare")


def extra_radius(extra: DataFrame) -> DataFrame:
    """Half the largest distance among an annotation's coordinates."""
    a, b = (extra.select(F.col("own_id").alias(f"{k}id"), F.col("pos").alias(f"{k}pos"), *(F.col(c).alias(f"{k}{c}") for c in "xyz")) for k in "ab")
    pairs = a.join(b, (F.col("aid") == F.col("bid")) & (F.col("apos") < F.col("bpos")))
    return pairs.groupBy(F.col("aid").alias("id")).agg((F.max(dist3(("ax", "ay", "az"), ("bx", "by", "bz"))) / 2).alias("radius"))


def scalebar_lengths(targets: DataFrame, bars: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Bars with both targets, measured; of targets with one label the last counts."""
    last = targets.groupBy("label").agg(F.max_by(F.struct("x", "y", "z"), "pos").alias("p"))
    t = targets.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(bars or SCALEBARS)], "bar int, target1 string, target2 string, length_m double")
    side = lambda k: last.select(F.col("label").alias(f"target{k}"), *(F.col(f"p.{c}").alias(f"{c}{k}") for c in "xyz"))
    out = t.join(side(1), "target1").join(side(2), "target2")
    return out.withColumn("dist", dist3(("x1", "y1", "z1"), ("x2", "y2", "z2"))).withColumn("factor", F.try_divide("length_m", "dist"))


def scale_factor(targets: DataFrame, bars: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """n, mean factor, population variance and standard error; nulls without bars."""
    out = scalebar_lengths(targets, bars).agg(F.count("*").alias("n"), F.avg("factor").alias("mean"), F.var_pop("factor").alias("variance"))
    return out.withColumn("sterr", F.try_divide(F.sqrt("variance"), F.sqrt(F.col("n").cast("double"))))
