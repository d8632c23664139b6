"""Grid designs, rasters and box searches over points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import components


#: Leading hex digits of a seeded order that make a bin.
BIN_DIGITS = 4


def _origin(points: DataFrame) -> DataFrame:
    return F.broadcast(points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")))  # one row


def cell_index(points: DataFrame, size: float) -> DataFrame:
    """points plus i, j of half-open cells counted from the least x and y."""
    return points.crossJoin(_origin(points)).withColumns({"i": F.floor((F.col("x") - F.col("x0")) / size).cast("int"), "j": F.floor((F.col("y") - F.col("y0")) / size).cast("int")})


def grid_cells(points: DataFrame, size: float) -> DataFrame:
    """All cells over the extent with their corners."""
    o = _origin(points).first()
    nx, ny = (0 if o.x0 is None else max(0, math.ceil((o[f"{a}1"] - o[f"{a}0"]) / size)) for a in "xy")
    rows = points.sparkSession.range(nx * ny).select(F.expr(f"cast(id div {max(1, ny)} as int)").alias("i"), F.expr(f"cast(id % {max(1, ny)} as int)").alias("j"))  # numbered over all tasks
    low = lambda a, k: F.lit(o[f"{a}0"]).cast("double") + F.col(k) * size
    return rows.select("i", "j", low("x", "i").alias("xmin"), low("y", "j").alias("ymin"), (low("x", "i") + size).alias("xmax"), (low("y", "j") + size).alias("ymax"))


def spread_filter(points: DataFrame, size: float, parts: int = 10, min_points: int = 1, min_share: float = 0.5) -> DataFrame:
    """Cells of which at least min_share of parts x parts subcells hold min_points points."""
    rows = cell_index(points, size)
    inside = lambda a, k: F.floor((F.col(a) - F.col(f"{a}0") - F.col(k) * size) / (size / parts)).cast("int")
    rows = rows.where((F.col("x0") + F.col("i") * size < F.col("x1")) & (F.col("y0") + F.col("j") * size < F.col("y1")))
    subs = rows.groupBy("i", "j", inside("x", "i").alias("m"), inside("y", "j").alias("n")).agg(F.count("*").alias("points")).where(F.col("points") >= min_points)
    return subs.groupBy("i", "j").agg(F.count("*").alias("filled")).where(F.col("filled") >= min_share * parts * parts)


def adjacent(cells: DataFrame) -> DataFrame:
    """Pairs of cells that share an edge, by index."""
    steps = cells.select("i", "j").withColumn("s", F.explode(F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")))))
    moved = steps.select("i", "j", (F.col("i") + F.col("s.di")).alias("i2"), (F.col("j") + F.col("s.dj")).alias("j2"))
    other = cells.select(F.col("i").alias("i2"), F.col("j").alias("j2"))
    return moved.join(other, ["i2", "j2"]).select("i", "j", "i2", "j2")


def largest_component(cells: DataFrame) -> DataFrame:
    """The cells of the largest edge-connected set; of equal ones that with the least first cell."""
    code = lambda i, j: (F.col(i).cast("long") * (1 << 31) + F.col(j).cast("long"))
    links = adjacent(cells).select(code("i", "j").alias("a"), code("i2", "j2").alias("b"))
    labels = cells.select("i", "j", code("i", "j").alias("node")).join(components(links), "node", "left")
    labels = labels.withColumn("comp", F.coalesce("comp", "node"))
    best = labels.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(1)
    return labels.join(F.broadcast(best), "comp").select("i", "j")


def subdivide(boxes: DataFrame, size: float, tolerance: float = 1e-9) -> DataFrame:
    """Boxes (box, xmin, ymin, xmax, ymax) cut into squares; sides must be multiples of the size."""
    n = lambda a: F.round((F.col(f"{a}max") - F.col(f"{a}min")) / size)
    exact = lambda a: F.abs(F.round(F.col(f"{a}max") - F.col(f"{a}min"), 4) - n(a) * size) <= tolerance + 1e-9
    rows = boxes.withColumn("ok", F.when(exact("x") & exact("y"), F.lit(True)).otherwise(F.raise_error(F.lit("box sides are no multiples of the cell size")).cast("boolean"))).where("ok")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), n("x").cast("int") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n("y").cast("int") - 1)))
    low = lambda a, k: F.col(f"{a}min") + F.col(k) * size
    return rows.select("box", "i", "j", low("x", "i").alias("cxmin"), low("y", "j").alias("cymin"), (low("x", "i") + size).alias("cxmax"), (low("y", "j") + size).alias("cymax"))


def seeded(*key: str, seed: str = "1") -> Column:
    """A reproducible order: md5 of the key and a seed, the same in any engine."""
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.lit(seed)))


def stratified(points: DataFrame, size: float, n: int, seed: str = "1") -> DataFrame:
    """Up to n points of every cell, in seeded order."""
    rows = cell_index(points, size).withColumn("h", seeded("point_id", seed=seed))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("i", "j").orderBy("h", "point_id"))).where(F.col("rank") <= n)


def random_in_cells(cells: DataFrame, n: int, seed: str = "1", z: float = 0.0) -> DataFrame:
    """n points in every cell (i, j, xmin .. ymax), uniform by the digits of a hash."""
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("h", seeded("i", "j", "k", seed=seed))
    part = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("double") / 4294967296
    return rows.select("i", "j", "k", (F.col("xmin") + part(1) * (F.col("xmax") - F.col("xmin"))).alias("x"), (F.col("ymin") + part(9) * (F.col("ymax") - F.col("ymin"))).alias("y"), F.lit(z).alias("z"))


def best_box(points: DataFrame, length: float, width: float, step: float = 0.1) -> DataFrame:
    """The box of bins that holds most points; of equal ones the first by x, then y.

    Two sliding sums over the bins; an empty bin that may start a best box is the
    neighbour of a filled one, so the dense grid is only made along filled rows.
    """
    a, b = max(1, round(length / step)), max(1, round(width / step))
    rows = cell_index(points, step)
    bins = rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("x1").alias("x1"), F.first("y1").alias("y1"))
    spread = bins.withColumn("di", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).withColumn("i", F.col("i") - F.col("di")).where("i >= 0").groupBy("i", "j").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    spread = spread.withColumn("dj", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("j", F.col("j") - F.col("dj")).where("j >= 0").groupBy("i", "j").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    last = lambda k, size: F.floor((F.col(f"{k}1") - F.col(f"{k}0")) / step).cast("int") - (size - 1)
    fits = spread.where((F.col("i") <= F.greatest(last("x", a), F.lit(0))) & (F.col("j") <= F.greatest(last("y", b), F.lit(0))))
    best = fits.orderBy(F.desc("n"), "i", "j").limit(1)
    return best.select("i", "j", "n", (F.col("x0") + F.col("i") * step).alias("xmin"), (F.col("y0") + F.col("j") * step).alias("ymin"), (F.col("x0") + F.col("i") * step + length).alias("xmax"), (F.col("y0") + F.col("j") * step + width).alias("ymax"))


def raster(points: DataFrame, size: float, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """iy, ix, n and mean values of pixels that hold points; the upper edge is outside."""
    rows = cell_index(points, size)
    inside = (F.col("i") < F.ceil((F.col("x1") - F.col("x0")) / size)) & (F.col("j") < F.ceil((F.col("y1") - F.col("y0")) / size))
    return rows.where(inside).groupBy(F.col("j").alias("iy"), F.col("i").alias("ix")).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def camera_raster(points: DataFrame, resolution: float = 0.005, window: tuple[float, float, float, float] | None = None, least: int = 100) -> DataFrame:
    """iy, ix, n and mean colours as bytes of an orthographic view, at least `least` pixels a side.

    window (xmin, ymin, xmax, ymax) crops the view, as to a mask; one without points
    falls back to the whole cloud.
    """
    box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        window = (0.0, 0.0, 0.0, 0.0)

    def drawn(x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        at = lambda c, low: F.floor((F.col(c) - F.lit(float(low))) / resolution).cast("int")
        width, height = (max(math.ceil((b - a) / resolution), least) for a, b in ((x0, x1), (y0, y1)))
        rows = points.withColumns({"ix": at("x", x0), "iy": at("y", y0)}).where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))
        # rounded first: a mean that is a whole number of bytes must not depend on the order of summation
        byte = lambda c: F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(c))) * 255, 6)).cast("int").alias(c)
        return rows.groupBy("iy", "ix").agg(F.count("*").alias("n"), *(byte(c) for c in "rgb"))

    if window is not None and (box[0] is None or drawn(*window).take(1)):
        return drawn(*window)
    return drawn(*box)


def decimate(points: DataFrame, k: int, seed: str = "1", key: str = "point_id") -> DataFrame:
    """Exactly min(k, n) points, the first k in seeded order.

    A histogram of the leading hex digits of the order tells where the k-th point lies;
    all points before that bin are taken where they are, and only the bin itself is sorted.
    """
    rows = points.withColumn("_h", seeded(key, seed=seed)).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    held = sorted((b, n) for b, n in rows.groupBy("_bin").count().collect())  # 16 ** BIN_DIGITS rows at most
    taken, edge = 0, None
    for b, n in held:
        if taken + n > k:
            edge = b
            break
        taken += n
    if edge is None:
        return points
    rest = rows.where(F.col("_bin") == edge).orderBy("_h", key).limit(k - taken)
    return rows.where(F.col("_bin") < edge).unionByName(rest).drop("_h", "_bin")
