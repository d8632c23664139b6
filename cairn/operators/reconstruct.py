"""Screened Poisson reconstruction of a surface from points with normals.

The field is solved on the nodes of nested grids, each kept only near the points: a
keyed table (i, j, k) a level, from a coarse one that spans the cloud to the finest.
Normals are spread over nodes by quadratic B-splines; the field is the one whose steps
along edges fit them best in the least squares, held near zero where points are dense.

A level starts from the field of the level above. Its nodes are then dealt to blocks
with a border: every block solves its own equations by conjugate gradients with the
border held, and all blocks exchange their values between rounds. A block has a bounded
number of nodes, nothing is held by the driver, and each round is written and read again.

The surface is where the field has its mean value at the points: each cell of eight nodes
is cut into six tetrahedra about its diagonal, the same way in every cell, so that
triangles of neighbouring cells share their corners, which are named by the edge they lie
on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.measures import triangle_area, trim_density
from cairn.session import cut

#: Nodes of a block's side and of its border, and nodes kept about a point.
BLOCK, BORDER, BAND = 16, 4, 3
COARSEST, ROUNDS = 3, 4
SCREEN = 0.02
NODE = ("i", "j", "k")
#: Steps of conjugate gradients in a block at most, and the share of the residual at which they end.
STEPS, ENOUGH = 400, 1e-6
#: Corners of the six tetrahedra of a cell; corner c lies at (c & 1, c >> 1 & 1, c >> 2).
TETRAHEDRA = [(0, a, a | b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


def _offsets(name: str, reach: int) -> Column:
    return F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias(name)


def band_nodes(points: DataFrame, low: tuple[float, float, float], size: float, band: int = BAND) -> DataFrame:
    """i, j, k, vx, vy, vz, w: the nodes near points, with the normals and the weight spread to them."""
    at = points.select(*(((F.col(a) - F.lit(low[n])) / F.lit(size)).alias(f"u{n}") for n, a in enumerate("xyz")), "nx", "ny", "nz")
    at = at.withColumns({c: F.floor(F.col(f"u{n}") + 0.5).cast("int") for n, c in enumerate(NODE)})
    near = at.select(*NODE).distinct()
    for c in NODE:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - band, F.col(c) + band))).distinct()
    rows = at
    for n, c in enumerate(NODE):
        rows = rows.select("*", _offsets(f"o{n}", 1))
        d = F.col(f"u{n}") - F.col(c)
        rows = rows.withColumn(f"w{n}", F.when(F.col(f"o{n}") == 0, 0.75 - d * d).otherwise(F.pow(0.5 + F.col(f"o{n}") * d, 2) / 2))
    w = F.col("w0") * F.col("w1") * F.col("w2")
    spread = rows.select(*((F.col(c) + F.col(f"o{n}")).alias(c) for n, c in enumerate(NODE)), w.alias("w"), "nx", "ny", "nz")
    spread = spread.groupBy(*NODE).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(f"n{a}")).alias(f"v{a}") for a in "xyz"))
    zero = F.lit(0.0)
    return near.join(spread, [*NODE], "left").select(*NODE, *(F.coalesce(c, zero).alias(c) for c in ("vx", "vy", "vz", "w")))


def _solved(block: int, border: int):
    """Own nodes of a block with their new values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[[*NODE]].to_numpy(np.int64)
        corner = pdf[["bi", "bj", "bk"]].to_numpy(np.int64)[0] * block
        shape = block + 2 * border + 2
        place = ((at - corner + border + 1) @ np.array([shape * shape, shape, 1])).astype(np.int64)
        number = np.full(shape**3, len(at), np.int64)
        number[place] = np.arange(len(at))
        away = np.maximum(corner - at, at - corner - block + 1).max(axis=1)
        free = away < border
        v, x, screen = pdf[["vx", "vy", "vz"]].to_numpy(), np.append(pdf["x"].to_numpy(), 0.0), pdf["screen"].to_numpy()
        around, b, degree = [], np.zeros(len(at)), np.zeros(len(at))
        wide = np.vstack([v, np.zeros(3)])
        for axis, step in enumerate((shape * shape, shape, 1)):
            for side in (-1, 1):
                n = number[np.clip(place + side * step, 0, shape**3 - 1)]
                known = n < len(at)
                around.append(n)
                degree += known
                b -= side * known * (v[:, axis] + wide[n, axis]) / 2
        pad = lambda p: np.append(p, 0.0)
        apply = lambda p: ((degree + screen) * p - sum(pad(p)[n] for n in around)) * free
        fixed = x[:-1] * ~free
        known = b * free + sum(pad(fixed)[n] for n in around) * free
        y = x[:-1] * free
        r = known - apply(y)
        p, rr = r.copy(), float(r @ r)
        enough = ENOUGH**2 * max(float(known @ known), 1e-30)
        for _ in range(STEPS):
            if rr <= enough:
                break
            q = apply(p)
            a = rr / float(p @ q)
            y += a * p
            r -= a * q
            rr, before = float(r @ r), rr
            p = r + rr / before * p
        own = away <= 0
        out = pdf.loc[own, [*NODE, "vx", "vy", "vz", "w", "screen"]].copy()
        out["x"] = y[own]
        return out

    return run


def _exchanged(nodes: DataFrame) -> DataFrame:
    """One round: every block with its border solved, own values kept."""
    rows = nodes
    for c, b in zip(NODE, ("bi", "bj", "bk"), strict=True):
        rows = rows.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) - BORDER) / BLOCK).cast("int"), F.floor((F.col(c) + BORDER) / BLOCK).cast("int"))))
    fields = "i int, j int, k int, vx double, vy double, vz double, w double, screen double, x double"
    return rows.groupBy("bi", "bj", "bk").applyInPandas(_solved(BLOCK, BORDER), fields)


def _from_coarse(nodes: DataFrame, coarse: DataFrame) -> DataFrame:
    """nodes plus x: the mean of the coarse nodes around each, 0 where there is none."""
    rows = nodes.select(*NODE)
    for c in NODE:
        rows = rows.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(F.floor(F.col(c) / 2).cast("int"), F.ceil(F.col(c) / 2).cast("int")))))
    held = coarse.select(*(F.col(c).alias(f"c{c}") for c in NODE), "x")
    means = rows.join(held, [f"c{c}" for c in NODE]).groupBy(*NODE).agg(F.avg("x").alias("x"))
    return nodes.join(means, [*NODE], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def poisson_field(points: DataFrame, depth: int, rounds: int = ROUNDS, screen: float = SCREEN) -> tuple[DataFrame, tuple[float, float, float], float, float] | None:
    """(nodes with their field x and weight w, the lowest corner, the size of a cell, the field's mean at the points); None without points.

    points have x, y, z and unit normals nx, ny, nz; those without a normal are left out.
    The grid has 2 ** depth cells along the longest side.
    """
    norm = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    points = points.where(norm > 0).select(*"xyz", *((F.col(f"n{a}") / norm).alias(f"n{a}") for a in "xyz"))
    box = points.agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max)))).first()
    if box.x0 is None:
        return None
    low = (box.x0, box.y0, box.z0)
    extent = max(box.x1 - box.x0, box.y1 - box.y0, box.z1 - box.z0, 1e-9)
    coarse = None
    for level in range(min(COARSEST, depth), depth + 1):
        size = extent / 2**level
        nodes = cut(band_nodes(points, low, size), "nodes")
        # a node among points of the usual density gets most of their normal, one at the rim little
        usual = nodes.agg((F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("w")).first()[0]
        dense = F.col("w") + 0.3 * usual
        nodes = nodes.withColumn("screen", screen * F.col("w") / dense).withColumns({f"v{a}": F.col(f"v{a}") / dense for a in "xyz"})
        nodes = nodes.withColumn("x", F.lit(0.0)) if coarse is None else _from_coarse(nodes, coarse)
        nodes = cut(nodes.select(*NODE, "vx", "vy", "vz", "w", "screen", "x"), "field")
        for _ in range(rounds):
            nodes = cut(_exchanged(nodes), "field")
        coarse = nodes
    level_of = coarse.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x")).first()[0]
    return coarse, low, size, level_of


def _cell_triangles(low: tuple[float, float, float], size: float, level: float):
    """Cells with the values of their eight corners, as triangles."""
    corner = np.array([(c & 1, c >> 1 & 1, c >> 2) for c in range(8)])

    def run(batches):
        for pdf in batches:
            at = pdf[[*NODE]].to_numpy(np.int64)
            value = pdf[[f"x{c}" for c in range(8)]].to_numpy() - level
            weight = pdf[[f"w{c}" for c in range(8)]].to_numpy()
            parts = []
            for tet in TETRAHEDRA:
                inside = value[:, tet] < 0
                # an inside corner and an outside one make a corner of a triangle
                for mask in range(1, 15):
                    ins = [t for n, t in enumerate(tet) if mask >> n & 1]
                    out = [t for n, t in enumerate(tet) if not mask >> n & 1]
                    some = np.flatnonzero((inside == [bool(mask >> n & 1) for n in range(4)]).all(axis=1))
                    if not len(some):
                        continue
                    if len(ins) == 2:
                        (a, b), (c, d) = ins, out
                        sides = [[(a, c), (a, d), (b, d)], [(a, c), (b, d), (b, c)]]
                    else:
                        sides = [[(a, b) for a in ins for b in out]]
                    middle = corner[out].mean(axis=0) - corner[ins].mean(axis=0)
                    for three in sides:
                        place, names, dense = [], [], []
                        for a, b in three:
                            share = value[some, a] / (value[some, a] - value[some, b])
                            ends = [at[some] + corner[a], at[some] + corner[b]]
                            place.append((ends[0] + share[:, None] * (corner[b] - corner[a])) * size + low)
                            code = [((e[:, 0] + (1 << 20)) << 42) | ((e[:, 1] + (1 << 20)) << 21) | (e[:, 2] + (1 << 20)) for e in ends]
                            names.append((np.minimum(*code), np.maximum(*code)))
                            dense.append(weight[some, a] + share * (weight[some, b] - weight[some, a]))
                        turned = np.einsum("ij,j->i", np.cross(place[1] - place[0], place[2] - place[0]), middle) < 0
                        frame = {}
                        for n, c in enumerate("abc"):
                            m = [0, 2, 1][n]
                            pick = lambda both: np.where(turned, both[1], both[0])  # noqa: B023, E731
                            lo, hi = pick((names[n][0], names[m][0])), pick((names[n][1], names[m][1]))
                            frame[c] = [f"{p}-{q}" for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
                            frame[f"{c}w"] = pick((dense[n], dense[m]))
                            for axis, x in enumerate("xyz"):
                                frame[f"{c}{x}"] = pick((place[n][:, axis], place[m][:, axis]))
                        parts.append(pd.DataFrame(frame))
            if parts:
                yield pd.concat(parts)[[f"{c}{x}" for c in "abc" for x in ("", "x", "y", "z", "w")]]

    return run


MESH = ", ".join(f"{c} string, {c}x double, {c}y double, {c}z double, {c}w double" for c in "abc")


def iso_surface(nodes: DataFrame, low: tuple[float, float, float], size: float, level: float) -> DataFrame:
    """Triangles (a, b, c and their ax .. cz, turned outwards, aw .. cw the density) where the field of nodes has a level; corners on no area are gone."""
    corners = nodes.select(*NODE, "x", "w", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c"))
    bit = lambda n: F.shiftright("c", n).bitwiseAND(1)
    corners = corners.select(*((F.col(a) - bit(n)).alias(a) for n, a in enumerate(NODE)), "c", "x", "w")
    held = [F.max(F.when(F.col("c") == c, F.col(v))).alias(f"{v}{c}") for v in "xw" for c in range(8)]
    cells = corners.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), *held)
    cells = cells.where((F.col("n") == 8) & (F.col("least") < F.lit(float(level))) & (F.col("most") >= F.lit(float(level)))).drop("n", "least", "most")
    rows = cells.mapInPandas(_cell_triangles(low, size, level), MESH)
    return rows.where((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))


def poisson_mesh(points: DataFrame, depth: int = 9, trim: float = 0.1, rounds: int = ROUNDS) -> DataFrame:
    """The triangles of the reconstructed surface, without those at the share `trim` of corners with the least density."""
    solved = poisson_field(points, depth, rounds)
    if solved is None:
        return points.sparkSession.createDataFrame([], MESH)
    rows = cut(iso_surface(*solved), "surface")
    if not trim:
        return rows
    ends = F.array(*(F.struct(F.col(c).alias("v"), F.col(f"{c}w").alias("density")) for c in "abc"))
    vertices = rows.select(F.explode(ends).alias("e")).select("e.v", "e.density").dropDuplicates(["v"])
    kept = cut(trim_density(vertices, trim).select("v"), "vertices")
    for c in "abc":
        rows = rows.join(kept.withColumnRenamed("v", c), c, "left_semi")
    return rows


def surface_area(mesh: DataFrame) -> DataFrame:
    """One row: triangles and their area."""
    return mesh.agg(F.count("*").alias("triangles"), F.sum(triangle_area("a", "b", "c")).alias("area"))


def open_sides(mesh: DataFrame) -> DataFrame:
    """Sides (lo, hi, n) that do not belong to exactly two triangles; none in a watertight mesh."""
    sides = F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))))
    return mesh.select(F.explode(sides).alias("e")).groupBy("e.lo", "e.hi").agg(F.count("*").alias("n")).where("n <> 2")
