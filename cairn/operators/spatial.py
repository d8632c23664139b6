"""Radius, nearest-neighbour and ray searches as bucketed equi-joins.

Space is cut into cells as wide as the search radius. The query side is repeated to
its neighbour cells, the point side is keyed once, and the join on the cell is an
ordinary hash or sort-merge join whose residual is the distance; a query never meets
a point more than two cells away.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import dist3
from cairn.operators import neighbourhoods as nb
from cairn.operators.orient import turn_to
from cairn.session import cut, parts, spread


def _cell(c: str | Column, width: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(width))).cast("long")


def _shifted(cell: Column, steps: Column) -> Column:
    return F.transform(steps, lambda s: cell + s)


def near(points: DataFrame, queries: DataFrame, radius: float, flat: bool = False, width: float | None = None, deep: bool = False) -> DataFrame:
    """Pairs within radius: the queries' columns as q_*, the points' as they are, and d.

    flat measures in xy only; deep has cells in z too, for queries that lie far above
    or below most points. Distances equal to the radius count.
    """
    width = width or radius
    reach = math.ceil(radius / width - 1e-12)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    cells = {"_i": "x", "_j": "y"} | ({"_k": "z"} if deep and not flat else {})
    for name, a in cells.items():
        q = q.withColumn(name, F.explode(_shifted(_cell(f"q_{a}", width), steps)))
    p = points.withColumns({name: _cell(a, width) for name, a in cells.items()})
    if deep:
        # the queries were repeated after Spark's size check saw them: they are not to be broadcast
        q = q.hint("merge")
    axes = "xy" if flat else "xyz"
    d = dist3(tuple(axes), tuple(f"q_{a}" for a in axes))
    return p.join(q, [*cells]).withColumn("d", d).where(F.col("d") <= F.lit(float(radius))).drop(*cells)


#: Columns that keep all pairs of a query in one task when they are grouped by beside q_id.
HOME = ["q_i", "q_j"]


def near_at_home(points: DataFrame, queries: DataFrame, radius: float, flat: bool = False, width: float | None = None) -> DataFrame:
    """Pairs as near gives them, plus HOME: for what is grouped over many pairs a query.

    Here the points are repeated to neighbour cells and a query stays in its own, so that a
    task has all pairs of its queries: groups by HOME and q_id need no shuffle, and pairs
    never move. Nothing is broadcast. Cells are half a radius wide by default.
    """
    width = width or radius / 2
    reach = math.ceil(radius / width - 1e-12)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    q = q.withColumns({h: _cell(f"q_{a}", width) for h, a in zip(HOME, "xy", strict=True)})
    p = points
    for h, a in zip(HOME, "xy", strict=True):
        p = p.withColumn(h, F.explode(_shifted(_cell(a, width), steps)))
    n = parts(points.sparkSession)
    axes = "xy" if flat else "xyz"
    d = dist3(tuple(axes), tuple(f"q_{a}" for a in axes))
    pairs = p.repartition(n, *HOME).join(q.repartition(n, *HOME).hint("merge"), HOME)
    return pairs.withColumn("d", d).where(F.col("d") <= F.lit(float(radius)))


def by_query(pairs: DataFrame, by: str = "q_id") -> list[str]:
    """What pairs are grouped by: HOME, where they have it, and the query."""
    return [*(h for h in HOME if h in pairs.columns), by]


def radius_join(points: DataFrame, queries: DataFrame, radius: float, drop_nearest: bool = False) -> DataFrame:
    """Points within radius of each query; optionally without each query's nearest."""
    pairs = near(points, queries, radius)
    if drop_nearest:
        by = Window.partitionBy("q_id").orderBy("d", "point_id")
        pairs = pairs.withColumn("rank", F.row_number().over(by)).where("rank > 1").drop("rank")
    return pairs


def radius_points(points: DataFrame, queries: DataFrame, radius: float, drop_nearest: bool = False) -> DataFrame:
    """id, point_id and d of the points within radius of each query (id, x, y, z), or of all but its nearest, tile by tile.

    A tile's pairs leave its task as they arise; for the nearest no pair is sorted or moved.
    """
    kind = points.schema["point_id"].dataType.simpleString()
    return nb.listed(points, queries, radius, nb.distances(drop_nearest), [*"xyz", "point_id"], f"point_id {kind}, d double")


def nearest_within(points: DataFrame, queries: DataFrame, radius: float, key: list[str], flat: bool = False) -> DataFrame:
    """For each query with a point within radius: key, d and the nearest point (ties by point_id)."""
    pairs = near(points, queries, radius, flat)
    best = F.min(F.struct("d", "point_id", "x", "y", "z")).alias("best")
    return pairs.groupBy(*(f"q_{k}" for k in key)).agg(best).select(*(F.col(f"q_{k}").alias(k) for k in key), "best.*")


def nearest(points: DataFrame, queries: DataFrame, start: float, key: list[str], flat: bool = False, rounds: int = 40) -> DataFrame:
    """The nearest point of every query, without a cap: the radius doubles for those still open."""
    found, left, radius = None, cut(queries, "open_queries"), start
    for _ in range(rounds):
        hit = cut(nearest_within(points, left, radius, key, flat), "nearest")
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit.select(*key), key, "left_anti"), "open_queries")
        if not left.take(1):
            break
        radius *= 2
    else:
        raise RuntimeError(f"queries without a nearest point after {rounds} rounds, at a radius of {radius}")
    return found


def z_intercept(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Queries (id, x, y): the candidate within radius in xy that is nearest to (x, y, median z)."""
    kind = points.schema["point_id"].dataType.simpleString()
    found = nb.measured(points, queries.select("id", "x", "y"), radius, nb.together(nb.surface_points()), [*"xyz", "point_id"], f"n long, median_z double, point_id {kind}, x double, y double, z double", flat=True)
    return found.where("n > 0").select("id", "median_z", "n", "point_id", *"xyz")


def growing_radius(distance: Column, radius: float, rounds: int = 1 << 16) -> Column:
    """The first multiple of radius that reaches the distance."""
    steps = F.greatest(F.lit(1.0), F.ceil(distance / radius).cast("double"))
    return steps * radius


def z_intercept_always(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """As z_intercept; where nothing is within radius, it grows by itself until something is, and z is the median there."""
    hit = cut(z_intercept(points, queries, radius), "z_intercepts")
    open_ = cut(queries.join(hit.select("id"), "id", "left_anti"), "open_queries")
    if not open_.take(1):
        return hit.select("id", "x", "y", "z", F.lit(False).alias("is_extrapolated"))
    far = nearest(points, open_.withColumn("z", F.lit(0.0)), 2 * radius, ["id"], flat=True)
    wide = open_.join(far.select("id", growing_radius(F.col("d"), radius).alias("reach")), "id")
    wide = cut(wide.withColumn("level", F.ceil(F.log2(F.col("reach") / radius) - 1e-9).cast("int")), "reaches")
    levels = sorted(row[0] for row in wide.select("level").distinct().collect())  # powers of two: a few dozen at most
    pairs = [near_at_home(points.select(*"xyz"), wide.where(F.col("level") == k).withColumn("z", F.lit(0.0)), radius * 2.0**k, flat=True, width=radius * 2.0**k).where("d <= q_reach") for k in levels]
    more = [some.groupBy(*by_query(some), "q_x", "q_y").agg(F.median("z").alias("z")) for some in pairs]
    more = reduce(DataFrame.unionByName, more)
    more = more.select(F.col("q_id").alias("id"), F.col("q_x").alias("x"), F.col("q_y").alias("y"), "z", F.lit(True).alias("is_extrapolated"))
    return hit.select("id", "x", "y", "z", F.lit(False).alias("is_extrapolated")).unionByName(more)


def search_radii(radius: float, most: float) -> list[float]:
    """The radii a ray search tries; repeated addition is part of its definition."""
    out = [radius]
    while out[-1] <= most:
        out.append(out[-1] + radius)
    return out


def _sampled(rays: DataFrame, step: float) -> DataFrame:
    """Rays (id, ox, oy, oz, tx, ty, tz) plus len, n (whole steps) and samples: how many places are tried."""
    rows = rays.withColumn("len", dist3(("ox", "oy", "oz"), ("tx", "ty", "tz")))
    rows = rows.withColumn("n", F.greatest(F.floor(F.col("len") / step), F.lit(1)).cast("long"))
    ends_early = (F.col("len") >= step) & ((F.col("n") - 1) * F.lit(float(step)) < F.col("len"))
    return rows.withColumn("samples", F.col("n") + ends_early.cast("long"))


def _along(t: Column) -> dict[str, Column]:
    """Coordinates at a distance t from a ray's origin."""
    return {a: F.col(f"o{a}") + t * F.coalesce(F.try_divide(F.col(f"t{a}") - F.col(f"o{a}"), F.col("len")), F.lit(0.0)) for a in "xyz"}


def _placed(rows: DataFrame, step: float) -> DataFrame:
    """id, sample, x, y, z; the sample after all whole steps is the target."""
    t = F.when(F.col("sample") < F.col("n"), F.col("sample") * F.lit(float(step))).otherwise(F.col("len"))
    return rows.select("id", "sample", *(c.alias(a) for a, c in _along(t).items()))


def line_samples(rays: DataFrame, step: float) -> DataFrame:
    """Rays (id, ox, oy, oz, tx, ty, tz) sampled every step from origin to target; the target itself is last."""
    rows = _sampled(rays, step).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1)))
    return _placed(rows, step)


#: How many parts a stretch of a ray is cut into where points are near.
PARTS = 16


def samples_near(rays: DataFrame, step: float, points: DataFrame, reach: float) -> DataFrame:
    """The line_samples that may have a point within reach, by a pyramid of occupied cells.

    Long stretches of rays meet coarse cells first. A stretch without a point near its
    middle is dropped whole, any other cut into parts that meet finer cells.
    """
    rows = _sampled(rays, step)
    longest = rows.agg(F.max("samples")).first()[0] or 0
    size = 1
    while size * PARTS < longest:
        size *= PARTS
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1, F.lit(size).cast("long"))))
    while size > 1:
        # nothing of the stretch is farther from its middle than half of it, or a step more where the target ends it
        middle = F.least((F.col("sample") + (size - 1) / 2) * F.lit(float(step)), F.col("len"))
        wide = (size / 2 + 2) * step + reach
        rows = near_points(rows.withColumns(_along(middle)), points, wide).drop(*"xyz")
        part = size // PARTS
        last = F.least(F.col("samples"), F.col("sample") + size) - 1
        rows = rows.withColumn("sample", F.explode(F.sequence(F.col("sample"), last, F.lit(part).cast("long"))))
        size = part
    return near_points(_placed(rows, step), points, reach)


def near_points(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The queries whose cell or a neighbour of it holds a point: whole cells are looked up, not points."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    own = {f"_{n}": _cell(a, radius) for n, a in zip("ijk", "xyz", strict=True)}
    cells = points.select(*(c.alias(n) for n, c in own.items())).distinct()
    for n in own:
        cells = cells.withColumn(n, F.explode(_shifted(F.col(n), steps)))
    # repeated cells are 27 times what Spark's size check sees: they are not to be broadcast
    return queries.withColumns(own).join(cells.distinct().hint("merge"), [*own], "left_semi").drop(*own)


def ray_intercept(points: DataFrame, rays: DataFrame, radius: float, most: float = 0.1, grow: bool = True) -> DataFrame:
    """The point a ray meets: at the least search radius that any sample needs, the earliest sample's nearest point.

    Without grow only the first radius counts. Rays that meet nothing give no row. Most
    rays meet something at the first radius; only the others are searched at the last.
    """
    radii = search_radii(radius, most) if grow else [radius]

    def met(some: DataFrame, reach: float) -> DataFrame:
        level = F.size(F.filter(F.array(*map(F.lit, radii)), lambda r: r < F.col("d")))
        hits = near(points.select("point_id", *"xyz"), samples_near(some, radius, points, reach), reach, deep=True)
        best = hits.groupBy("q_id").agg(F.min(F.struct(level.alias("level"), F.col("q_sample").alias("sample"), "d", "point_id", "x", "y", "z")).alias("h"))
        return best.select(F.col("q_id").alias("id"), "h.level", "h.sample", "h.d", "h.point_id", "h.x", "h.y", "h.z")

    if len(radii) == 1:
        return met(rays, radii[0])
    rays = cut(rays, "rays")
    first = cut(met(rays, radii[0]), "ray_hits")
    return first.unionByName(met(rays.join(first.select("id"), "id", "left_anti"), radii[-1]))


def grid_nodes(bounds: DataFrame, step: float) -> DataFrame:
    """Nodes (id, ix, iy, x, y, z) over a one-row xmin..ymax, zmax; upper ends are left out, z is above all."""
    box = bounds.first()
    nx, ny = (0 if box.xmin is None else max(0, math.ceil((box[f"{a}max"] - box[f"{a}min"]) / step)) for a in "xy")
    # numbered over all tasks, with the bounds beside each number
    rows = bounds.sparkSession.range(nx * ny).select(F.expr(f"cast(id div {max(1, ny)} as int)").alias("ix"), F.expr(f"cast(id % {max(1, ny)} as int)").alias("iy"), *(F.lit(box[c]).cast("double").alias(c) for c in ("xmin", "ymin", "zmax")))
    return rows.select("ix", "iy", (F.col("xmin") + F.col("ix") * step).alias("x"), (F.col("ymin") + F.col("iy") * step).alias("y"), (F.col("zmax") + step).alias("z"))


def bounding_box(points: DataFrame) -> DataFrame:
    """One row of xmin .. zmax."""
    return points.agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def grid_intercept(points: DataFrame, step: float, cap: float | None = None) -> DataFrame:
    """For every grid node the nearest point in xy, however far; with a cap only nodes that have one within it."""
    nodes = grid_nodes(bounding_box(points), step)
    if cap is None:
        return nearest(points, nodes, step / 2, ["ix", "iy"], flat=True)
    return nearest_within(points, nodes, cap, ["ix", "iy"], flat=True)


def _with_next(markers: DataFrame) -> DataFrame:
    """Markers (pos, x, y, z) but the last, with the next one's place as x2, y2, z2.

    Markers are dealt by ranges of pos; a range's last one is followed by the first of the
    next range, so that no task needs the order of all.
    """
    rows = markers.select("pos", *"xyz").repartitionByRange(parts(markers.sparkSession), "pos").sortWithinPartitions("pos")
    rows = cut(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "markers")
    here = [F.col(a) for a in "xyz"]
    firsts = rows.groupBy("part").agg(F.min(F.struct("at", *here)).alias("first"))
    later = F.lead("first").over(Window.orderBy("part"))  # a row a task
    firsts = firsts.select("part", *(later[a].alias(f"{a}3") for a in "xyz"))
    inside = Window.partitionBy("part").orderBy("at")
    rows = rows.withColumns({f"{a}2": F.lead(a).over(inside) for a in "xyz"} | {"more": F.lead("at").over(inside).isNotNull()})
    rows = rows.join(F.broadcast(firsts), "part")
    follow = {f"{a}2": F.when(F.col("more"), F.col(f"{a}2")).otherwise(F.col(f"{a}3")) for a in "xyz"}
    return rows.withColumns(follow).select("pos", *"xyz", "x2", "y2", "z2").where("x2 is not null")


def transect_points(markers: DataFrame, n: int = 50) -> DataFrame:
    """Markers (pos, x, y, z) joined by straight segments of n points, both ends included."""
    rows = _with_next(markers).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("pos", "k", *((F.col(a) + (F.col(f"{a}2") - F.col(a)) * F.col("k") / (n - 1)).alias(a) for a in "xyz"))


def _near_line(hits: DataFrame, line: DataFrame, reach: float, key: list[str]) -> DataFrame:
    """key and d: the hits within reach in xy of a line's points, and how far they are from it.

    A line has far more points than there are hits: the hits are repeated to neighbour cells.
    """
    close = near(line.select(*"xyz"), hits.select(*key, *"xyz"), reach, flat=True)
    return close.groupBy(*(F.col(f"q_{k}").alias(k) for k in key)).agg(F.min("d").alias("d"))


def transect_sample(points: DataFrame, markers: DataFrame, step: float, reach: float) -> DataFrame:
    """Grid intercepts up to half a step away, within reach in xy of the transect."""
    return _near_line(cut(grid_intercept(points, step, step / 2), "grid_hits"), transect_points(markers), reach, ["ix", "iy", "point_id"])


def grid_raycast(points: DataFrame, step: float, vector: tuple[float, float, float] = (0.0, 0.0, 1.0), cap: float | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """For each grid node the point nearest to the line through it along a vector, within cap (half a step by default).

    The grid lies over the bounds (the cloud's own by default) and is turned to the
    vector; turning the points back instead makes the distance to a line one in xy.
    """
    nodes = grid_nodes(bounding_box(points) if bounds is None else bounds, step)
    turned = turn_to(points.select("point_id", *"xyz"), vector)
    hits = nearest_within(turned, nodes, cap or step / 2, ["ix", "iy"], flat=True)
    return hits.select("ix", "iy", "d", "point_id").join(points, "point_id")


def along_transect(hits: DataFrame, markers: DataFrame, reach: float, vector: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """hits (ix, iy, point_id, x, y, z) within reach of the transect, seen along the vector, and how far, d."""
    flat = turn_to(hits.select("ix", "iy", "point_id", *"xyz"), vector)
    return _near_line(cut(flat, "grid_hits"), turn_to(transect_points(markers), vector), reach, ["ix", "iy", "point_id"])


def transect_raycast(points: DataFrame, markers: DataFrame, step: float, reach: float, vector: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Rays of a grid over the markers' box, meeting points up to a step away, kept within reach of the transect."""
    return along_transect(grid_raycast(points, step, vector, step, bounding_box(markers)), markers, reach, vector)


def transect_nearest(points: DataFrame, markers: DataFrame, step: float, reach: float, cap: float = 0.01) -> DataFrame:
    """Points within cap in xy of the nodes of a grid over the cloud, kept within reach of the transect."""
    return along_transect(grid_intercept(points, step, cap), markers, reach)


def snapped(points: DataFrame, places: DataFrame, surface: float, snap: float = 0.01) -> DataFrame:
    """Places (id, x, y) dropped onto the surface of points within `surface` in xy, and the nearest point if within snap of that."""
    down = z_intercept(points, places.select("id", "x", "y"), surface).select("id", F.col("median_z").alias("z"))
    return nearest_within(points, places.select("id", "x", "y").join(down, "id"), snap, ["id"])


def distance_matrix(rows: DataFrame, key: str = "id") -> DataFrame:
    """All ordered pairs with their distance; meant for sets of annotations, the right side is broadcast when small."""
    a = spread(rows).select(F.col(key).alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = rows.select(F.col(key).alias("b"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    return a.crossJoin(b).select("a", "b", dist3(("ax", "ay", "az"), ("bx", "by", "bz")).alias("d"))
