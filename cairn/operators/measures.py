"""Measurements of point neighbourhoods, grouped by q_id (see spatial.near).

Each is one or two grouped aggregates with partial aggregation; a neighbourhood is
never collected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import clip, eigen3, eigenvector3, from_plane
from cairn.operators import neighbourhoods as nb
from cairn.operators.graph import components
from cairn.operators.spatial import HOME, by_query, near_at_home
from cairn.session import cut

INLIER_RANGE = 0.01
CANOPY_SPACING = 0.01
#: Pixels or nodes that are kept as the bits of one long.
BITS = 60


def covariance(points: DataFrame, by: str = "q_id") -> DataFrame:
    """n, means and the sample covariance of each group."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return points.groupBy(*by_query(points, by)).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs))


def planes(points: DataFrame, by: str = "q_id", inlier: float = INLIER_RANGE, align: bool = True) -> DataFrame:
    """Best-fit plane of each group: unit normal (a, b, c), offset d, eigenvalues, inliers.

    The normal is the least eigenvector; with align it points to the side of the mean
    normal of its inliers.
    """
    stats = plane_fits(points, by)
    return _about_planes(points.join(stats, by), by, [k for k in stats.columns if k != by], inlier, align)


def plane_fits(points: DataFrame, by: str = "q_id") -> DataFrame:
    """n, means, eigenvalues and the plane (pa, pb, pc, pd) of each group."""
    stats = covariance(points, by)
    c = [F.col(k) for k in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")]
    l1, l2, l3 = eigen3(*c)
    stats = stats.withColumns({"l1": l1, "l2": l2, "l3": l3}).withColumn("v", eigenvector3(F.col("l3"), *c))
    stats = stats.select(by, "n", "mx", "my", "mz", "l1", "l2", "l3", F.col("v.x").alias("pa"), F.col("v.y").alias("pb"), F.col("v.z").alias("pc"))
    return stats.withColumn("pd", -(F.col("pa") * F.col("mx") + F.col("pb") * F.col("my") + F.col("pc") * F.col("mz")))


def plane_inliers(points: DataFrame, plane: tuple, inlier: float = INLIER_RANGE) -> DataFrame:
    """The points at most inlier away from a plane (a, b, c, d), given as numbers or as names of columns."""
    return points.where(from_plane(plane) <= inlier)


def _about_planes(points: DataFrame, by: str, keep: list[str], inlier: float, align: bool) -> DataFrame:
    """What points that carry their group's plane say about it."""
    joined = points.withColumn("away", from_plane(("pa", "pb", "pc", "pd"))).withColumn("inlier", F.col("away") <= inlier)
    mean = [F.avg(F.when(F.col("inlier"), F.col(k))).alias(f"i{k}") for k in ("nx", "ny", "nz")] if align else []
    out = joined.groupBy(*by_query(joined, by), *keep).agg(F.avg("away").alias("rugosity"), F.count(F.when(F.col("inlier"), 1)).alias("inliers"), *mean)
    if align:
        turn = F.when(F.col("pa") * F.col("inx") + F.col("pb") * F.col("iny") + F.col("pc") * F.col("inz") < 0, -1.0).otherwise(1.0)
        out = out.withColumn("turn", turn).withColumns({f"p{k}": F.col(f"p{k}") * F.col("turn") for k in "abcd"}).drop("turn", "inx", "iny", "inz")
    return out.withColumnsRenamed({f"p{k}": k for k in "abcd"}).drop(*HOME)


def planes_at(points: DataFrame, queries: DataFrame, radius: float, inlier: float = INLIER_RANGE) -> DataFrame:
    """planes of the points within radius of each query (id, x, y, z): points are met twice in one task, pairs never move."""
    found = nb.measured(points, queries, radius, nb.together(nb.planes(inlier)), [*"xyz", "nx", "ny", "nz"], nb.PLANES)
    return found.where("n > 0").withColumnRenamed("id", "q_id")


def principal_axis(points: DataFrame, plane: str = "xy") -> DataFrame:
    """One row ax, ay, az: the direction of most spread, laid into a plane (not lengthened again).

    Its largest part is positive, as a direction has two signs.
    """
    if plane.lower() not in ("xy", "xz", "yz"):
        raise ValueError("plane must be 'xy', 'xz' or 'yz'")
    fitted = covariance(points.withColumn("_all", F.lit(1)), "_all")
    c = [F.col(k) for k in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")]
    fitted = fitted.withColumn("l1", eigen3(*c)[0]).withColumn("v", eigenvector3(F.col("l1"), *c))
    sign = F.when(F.greatest(*(F.abs(f"v.{a}") for a in "xyz")) == F.greatest(*(F.col(f"v.{a}") for a in "xyz")), 1.0).otherwise(-1.0)
    return fitted.select(*((F.col(f"v.{a}") * sign if a in plane.lower() else F.lit(0.0)).alias(f"a{a}") for a in "xyz"))


def rugosity_3d(area_2d: Column, area_3d: Column) -> Column:
    """Area of the surface over that of its outline; null for an outline without area."""
    return F.try_divide(area_3d, area_2d)


def plane_angles(fitted: DataFrame) -> DataFrame:
    """theta, psi, azimuth and elevation in degrees beside a plane's columns."""
    flat = (F.abs("a") < 1e-12) & (F.abs("b") < 1e-12)
    azimuth = F.when(~flat, F.pmod(F.degrees(F.atan2("a", "b")) + 360, F.lit(360.0)))
    return fitted.withColumns({"theta": F.degrees(F.atan(F.try_divide("a", "c"))), "psi": F.degrees(F.atan(F.try_divide("b", "c"))), "azimuth": azimuth, "elevation": F.degrees(F.acos(clip(F.col("c"), -1.0, 1.0)))})


def vector_dispersion(points: DataFrame, by: str = "q_id") -> DataFrame:
    """(n - R) / (n - 1), R the length of the sum of unit normals; null for one point."""
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    sums = points.groupBy(*by_query(points, by)).agg(F.count("*").alias("n"), *(F.sum(F.try_divide(F.col(f"n{a}"), norm)).alias(f"s{a}") for a in "xyz"))
    length = F.sqrt(sum(F.col(f"s{a}") * F.col(f"s{a}") for a in "xyz"))
    return sums.select(by, "n", F.try_divide(F.col("n") - length, F.col("n") - 1).alias("dispersion"))


def rgb_stats(points: DataFrame, by: str = "q_id") -> DataFrame:
    """Median colours and the luminance of the medians."""
    out = points.groupBy(*by_query(points, by)).agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in "rgb")).drop(*HOME)
    return _with_luminance(out)


def rgb_stats_at(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """rgb_stats of the points within radius of each query (id, x, y, z)."""
    found = nb.measured(points, queries, radius, nb.together(nb.counts, nb.medians([*"rgb"])), [*"xyz", *"rgb"], "n long, r double, g double, b double")
    return _with_luminance(found.where("n > 0").withColumnRenamed("id", "q_id"))


def vector_dispersion_at(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """vector_dispersion of the points within radius of each query (id, x, y, z)."""
    found = nb.measured(points, queries, radius, nb.together(nb.counts, nb.dispersion), [*"xyz", "nx", "ny", "nz"], "n long, dispersion double")
    return found.where("n > 0").withColumnRenamed("id", "q_id")


def _with_luminance(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows.withColumn("luminance", 0.2126 * F.col(f"{prefix}r") + 0.7152 * F.col(f"{prefix}g") + 0.0722 * F.col(f"{prefix}b"))


def fractal_dimension(points: DataFrame, iterations: int = 10) -> DataFrame:
    """Box-counting dimension of one cloud: slope of ln(boxes) on ln(1 / size) while the size halves."""
    box = points.agg(*(F.min(a).alias(f"{a}0") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("extent"))
    finest = F.col("extent") * 1.0001 / 2.0 ** (iterations - 1)
    cells = points.crossJoin(F.broadcast(box)).select("extent", *(F.floor((F.col(a) - F.col(f"{a}0")) / finest).alias(f"i{a}") for a in "xyz")).distinct()  # one row beside
    # a box of each coarser level is eight of the finer: only the finest level looks at points
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    rows = rows.select("level", (F.col("extent") * 1.0001 / F.pow(F.lit(2.0), F.col("level"))).alias("size"), *(F.expr(f"shiftright(i{a}, cast({iterations - 1} - level as int))").alias(f"i{a}") for a in "xyz"))
    counts = rows.distinct().groupBy("level", "size").agg(F.count("*").alias("boxes"))
    return counts.agg(F.regr_slope(F.log(F.col("boxes").cast("double")), -F.log("size")).alias("dimension"), F.max("boxes").alias("most"))


def gap_pixels(pairs: DataFrame, resolution: int = 200) -> DataFrame:
    """Points above the query's centre with their pixel (px, py) in a hemispherical image and distance."""
    dx, dy, dz = (F.col(a) - F.col(f"q_{a}") for a in "xyz")
    rows = pairs.where(dz > 0)
    norm = F.sqrt(dx * dx + dy * dy + dz * dz)
    theta, phi = F.atan2(dy, dx), F.acos(dz / norm)
    pixel = lambda f: F.greatest(F.lit(0), F.least(F.lit(resolution - 1), ((phi * f(theta) + math.pi / 2) / math.pi * resolution).cast("int")))
    return rows.withColumns({"px": pixel(F.cos), "py": pixel(F.sin), "norm": norm})


def disc_pixels(resolution: int = 200) -> int:
    """Pixels of the imaging disc."""
    r = resolution // 2
    return sum((x - r) ** 2 + (y - r) ** 2 <= r * r for x in range(resolution) for y in range(resolution))


def within_xy(pairs: DataFrame, radius: float | None) -> DataFrame:
    """Pairs no farther apart than radius in xy; all without one."""
    return pairs if radius is None else pairs.where(F.hypot(F.col("x") - F.col("q_x"), F.col("y") - F.col("q_y")) <= F.lit(float(radius)))


def gap_fraction(pairs: DataFrame, resolution: int = 200, queries: DataFrame | None = None, max_radius: float | None = None) -> DataFrame:
    """q_id, covered pixels and the share of the disc without any; with queries (id) also those under an open sky."""
    # the pixels of a row are bits of a few words: far fewer groups than pixels
    bits = gap_pixels(within_xy(pairs, max_radius), resolution).withColumn("word", F.floor(F.col("py") / BITS))
    bits = bits.groupBy(*by_query(pairs), "px", "word").agg(F.bit_or(F.expr(f"shiftleft(1L, py % {BITS})")).alias("set"))
    out = bits.groupBy(*by_query(pairs)).agg(F.sum(F.bit_count("set")).alias("covered")).drop(*HOME)
    if queries is not None:
        out = queries.select(F.col("id").alias("q_id")).join(out, "q_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return _with_gap(out, resolution)


def gap_fraction_at(points: DataFrame, queries: DataFrame, radius: float, resolution: int = 200, max_radius: float | None = None) -> DataFrame:
    """gap_fraction of the points within radius of each query (id, x, y, z), also of those under an open sky."""
    images = nb.sky_images(resolution, np.count_nonzero, "covered", max_radius)
    found = nb.measured(points, queries, radius, nb.together(images), [*"xyz"], "covered long")
    return _with_gap(found.select(F.col("id").alias("q_id"), F.coalesce("covered", F.lit(0).cast("long")).alias("covered")), resolution)


def _with_gap(rows: DataFrame, resolution: int) -> DataFrame:
    area = disc_pixels(resolution)
    return rows.withColumn("gap_raw", (F.lit(area) - F.col("covered")) / F.lit(float(area)))


def pixel_colours_at(points: DataFrame, queries: DataFrame, radius: float, resolution: int = 200) -> DataFrame:
    """pixel_colours of the points within radius of each query (id, x, y, z)."""
    found = nb.listed(points, queries, radius, nb.nearest_colours(resolution), [*"xyz", "point_id", *"rgb"], "px int, py int, point_id long, r int, g int, b int")
    return found.withColumnRenamed("id", "q_id")


def pixel_colours(pairs: DataFrame, resolution: int = 200) -> DataFrame:
    """The nearest point's colour for every covered pixel."""
    best = F.min(F.struct("norm", "point_id", "r", "g", "b")).alias("p")
    return gap_pixels(pairs, resolution).groupBy("q_id", "px", "py").agg(best).select("q_id", "px", "py", "p.point_id", *(F.floor(F.col(f"p.{c}") * 255).cast("int").alias(c) for c in "rgb"))


def filled_circle(queries: DataFrame, radius: float, step: float) -> DataFrame:
    """Nodes of a square grid inside a disc about each query."""
    n = math.ceil((2 * radius + step) / step - 1e-9)
    k = F.sequence(F.lit(0), F.lit(n - 1))
    rows = queries.withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    x, y = F.lit(-radius) + F.col("i") * step, F.lit(-radius) + F.col("j") * step
    return rows.where(x * x + y * y <= radius * radius + 1e-12).select("id", "i", "j", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), "z")


def canopy_cover(points: DataFrame, queries: DataFrame, radius: float = 0.2, step: float = CANOPY_SPACING, reach: float | None = None) -> DataFrame:
    """Share of the grid over the hemisphere's base that some projected point covers.

    reach limits which points are seen; the directions of all others are ignored.
    """
    found = nb.measured(points, queries, reach or radius, nb.together(nb.canopy(radius, step)), [*"xyz"], "covered long")
    one = queries.sparkSession.createDataFrame([("all", 0.0, 0.0, 0.0)], "id string, x double, y double, z double")
    total = F.lit(filled_circle(one, radius, step).count())
    out = found.withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    return out.select("id", total.alias("total"), "covered", (F.col("covered") / total).alias("cover"))


def ransac_plane(points: DataFrame, iterations: int = 1000, inlier: float = INLIER_RANGE, seed: int = 1) -> DataFrame:
    """The plane through three points that most points lie near; triples are drawn by hash.

    Triples number `iterations` and are broadcast; points are scanned once.
    """
    drawn = points.select("x", "y", "z", F.xxhash64("point_id", F.lit(seed)).alias("h")).orderBy("h").limit(3 * iterations).collect()
    triples = [(k, *drawn[3 * k][:3], *drawn[3 * k + 1][:3], *drawn[3 * k + 2][:3]) for k in range(len(drawn) // 3)]
    names = ["k"] + [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]
    t = points.sparkSession.createDataFrame(triples, ", ".join(["k int"] + [f"{n} double" for n in names[1:]]))
    u = {a: F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz"}
    v = {a: F.col(f"{a}3") - F.col(f"{a}1") for a in "xyz"}
    n = {"a": u["y"] * v["z"] - u["z"] * v["y"], "b": u["z"] * v["x"] - u["x"] * v["z"], "c": u["x"] * v["y"] - u["y"] * v["x"]}
    t = t.select("k", *(e.alias(c) for c, e in n.items()), "x1", "y1", "z1").withColumn("len", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2)).where("len > 0")
    t = t.select("k", *((F.col(c) / F.col("len")).alias(c) for c in "abc"), "x1", "y1", "z1").withColumn("d", -(F.col("a") * F.col("x1") + F.col("b") * F.col("y1") + F.col("c") * F.col("z1")))
    away = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    scored = points.crossJoin(F.broadcast(t)).where(away <= inlier).groupBy("k", *"abcd").agg(F.count("*").alias("inliers"))
    return scored.orderBy(F.desc("inliers"), "k").limit(1)


def mask_areas(masks: DataFrame) -> DataFrame:
    """The area of each annotation's chosen mask; masks has q_id and area_cm2."""
    return masks.groupBy("q_id").agg(F.first("area_cm2").alias("cm2"))


#: name -> builder(grouped point pairs) of a table keyed by q_id; MASKED ones get the masks instead.
REGISTRY = {"gap_fraction": gap_fraction, "rgb": rgb_stats, "rugosity": planes, "dispersion": vector_dispersion, "mask_area": mask_areas, "plane_angles": lambda p: plane_angles(planes(p))}
MASKED = {"mask_area"}
#: Measurements that come from one plane of the neighbourhood.
PLANAR = {"rugosity": planes, "plane_angles": plane_angles}


def register(name: str, build) -> None:
    """Add a measurement of one's own: build(pairs) gives a table keyed by q_id."""
    REGISTRY[name] = build


#: What measurements take that are made tile by tile: of a tile, columns of the points, and what comes of it.
TILED = {
    "gap_fraction": (nb.sky_images(200, np.count_nonzero, "covered"), [], "covered long"),
    "rgb": (nb.medians([*"rgb"], "median_"), [*"rgb"], "median_r double, median_g double, median_b double"),
    "dispersion": (nb.dispersion, ["nx", "ny", "nz"], "dispersion double"),
    "planes": (nb.planes(INLIER_RANGE), ["nx", "ny", "nz"], nb.PLANES.removeprefix("n long, ")),
}
_PLANE = [c.split()[0] for c in nb.PLANES.split(", ")]
#: name -> the measurement in TILED, and the columns that come of it.
FROM_TILES = {
    "gap_fraction": ("gap_fraction", ["covered", "gap_raw"]),
    "rgb": ("rgb", ["n", "median_r", "median_g", "median_b", "luminance"]),
    "dispersion": ("dispersion", ["n", "dispersion"]),
    "rugosity": ("planes", _PLANE),
    "plane_angles": ("planes", [*_PLANE, "theta", "psi", "azimuth", "elevation"]),
}
BUILT_IN = dict(REGISTRY)


def measure_at(points: DataFrame, queries: DataFrame, radius: float, names: list[str], masks: DataFrame | None = None) -> DataFrame:
    """measure of the points within radius of each query (id, x, y, z): all built-in ones in one pass over tiles, pairs never move.

    A query with points but none above it has an open sky: its gap fraction is 1.
    """
    _known(names, masks)
    queries = queries.select("id", *"xyz")
    tiled = [n for n in names if n in FROM_TILES and REGISTRY[n] is BUILT_IN[n]]
    rest = [n for n in names if n not in tiled]
    out = None
    if tiled:
        made = list(dict.fromkeys(FROM_TILES[n][0] for n in tiled))
        columns = list(dict.fromkeys([*"xyz", *(c for k in made for c in TILED[k][1])]))
        kernels = nb.together(nb.counts, *(TILED[k][0] for k in made))
        found = nb.measured(points, queries, radius, kernels, columns, ", ".join(["n long", *(TILED[k][2] for k in made)])).where("n > 0").withColumnRenamed("id", "q_id")
        for name, further in (("gap_fraction", lambda t: _with_gap(t, 200)), ("rgb", lambda t: _with_luminance(t, "median_")), ("plane_angles", plane_angles)):
            found = further(found) if name in tiled else found
        out = found.select("q_id", *(F.col(c).alias(f"{n}_{c.removeprefix('median_')}") for n in tiled for c in FROM_TILES[n][1]))
    if rest:
        table = measure(near_at_home(points, queries, radius) if set(rest) - MASKED else None, rest, masks)
        out = table if out is None else out.join(table, "q_id", "outer")
    return out


def _known(names: list[str], masks: DataFrame | None) -> None:
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"no measurement named {unknown}; there are {sorted(REGISTRY)}")
    if masks is None and (wanted := MASKED & set(names)):
        raise ValueError(f"{sorted(wanted)} take masks")


def measure(pairs: DataFrame, names: list[str], masks: DataFrame | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Several named measurements side by side; planes are fitted once for all that need them, unless they are given.

    mask_area takes masks: one row (q_id, area_cm2) for each annotation that has one.
    """
    _known(names, masks)
    if fitted is None and len(PLANAR.keys() & set(names)) > 1:
        fitted = cut(planes(pairs), "planes")
    out = None
    for name in names:
        if fitted is not None and name in PLANAR:
            table = fitted if PLANAR[name] is planes else PLANAR[name](fitted)
        else:
            table = REGISTRY[name](masks if name in MASKED else pairs)
        table = table.select("q_id", *(F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "q_id"))
        out = table if out is None else out.join(table, "q_id", "outer")
    return out


def triangle_area(ax: str, bx: str, cx: str) -> Column:
    """Half the cross product of two edges; the arguments prefix x, y, z columns."""
    u = [F.col(f"{bx}{a}") - F.col(f"{ax}{a}") for a in "xyz"]
    v = [F.col(f"{cx}{a}") - F.col(f"{ax}{a}") for a in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(sum(k * k for k in n)) / 2


def mesh_area(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Total area and number of triangles (a, b, c) over vertices (v, x, y, z)."""
    out = triangles
    for k in "abc":
        out = out.join(vertices.select(F.col("v").alias(k), *(F.col(t).alias(f"{k}{t}") for t in "xyz")), k)
    return out.agg(F.sum(triangle_area("a", "b", "c")).alias("area"), F.count("*").alias("triangles"))


def mesh_clusters(triangles: DataFrame) -> DataFrame:
    """t, comp: triangles (t, a, b, c) connected over shared edges."""
    ends = F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))))
    edges = triangles.select("t", F.explode(ends).alias("e")).select("t", "e.lo", "e.hi")
    first = edges.groupBy("lo", "hi").agg(F.min("t").alias("t0"))
    links = edges.join(first, ["lo", "hi"]).where("t <> t0").select(F.col("t").alias("a"), F.col("t0").alias("b"))
    labels = components(links, in_order=triangles.schema["t"].dataType.simpleString() == "bigint").select(F.col("node").alias("t"), "comp")
    return triangles.select("t").join(labels, "t", "left").select("t", F.coalesce("comp", "t").alias("comp"))


def trim_density(vertices: DataFrame, share: float = 0.1) -> DataFrame:
    """Vertices without those below the given quantile of density."""
    low = F.broadcast(vertices.agg(F.percentile("density", F.lit(share)).alias("low")))  # one row
    return vertices.crossJoin(low).where("density >= low").drop("low")


def cell_area(points: DataFrame, size: float) -> DataFrame:
    """Area of the occupied cells of one cloud seen along its own plane: a substitute for an alpha shape."""
    fitted = planes(points.withColumn("q_id", F.lit(1)), align=False).select("a", "b", "c")
    flat = points.crossJoin(F.broadcast(fitted))  # one row
    helper = F.when(F.abs("a") < 0.9, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    flat = flat.withColumn("h", helper).withColumns({"ux": -F.col("c") * F.col("h.y"), "uy": F.col("c") * F.col("h.x"), "uz": F.col("a") * F.col("h.y") - F.col("b") * F.col("h.x")})
    n = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    flat = flat.withColumns({k: F.col(k) / n for k in ("ux", "uy", "uz")})
    v = (F.col("b") * F.col("uz") - F.col("c") * F.col("uy"), F.col("c") * F.col("ux") - F.col("a") * F.col("uz"), F.col("a") * F.col("uy") - F.col("b") * F.col("ux"))
    along = F.col("x") * F.col("ux") + F.col("y") * F.col("uy") + F.col("z") * F.col("uz")
    across = F.col("x") * v[0] + F.col("y") * v[1] + F.col("z") * v[2]
    cells = flat.select(F.floor(along / size).alias("i"), F.floor(across / size).alias("j")).distinct()
    return cells.agg((F.count("*") * size * size).alias("area"))
