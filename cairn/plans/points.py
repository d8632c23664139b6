"""Queries over points and annotations, each beside its DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cairn.functions import transforms as t
from cairn.functions.columns import affine, clip, dot3, dot4, homogeneous, on_plane, radius_from_area, rotate, vector_angle, zyx_angles
from cairn.operators import annotations as an
from cairn.operators import grids, measures, orient, spatial
from cairn.plans.fixtures import load, sql

R = 0.5
QUERIES, SQL = {}, {}


def query(twin: str | None, *fixtures: str):
    """Register a query(spark, sf_dir, *fixture tables) and its twin."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(*(load(spark, sf_dir, n) for n in fixtures))
        if twin is not None:
            SQL[name] = sql(twin, *fixtures)
        return f

    return add


def r(column, digits: int = 4):
    """Rounded, without negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def scaled_round(column, digits: int):
    """A length rounded by its multiple of the last place, as the twins' engine does it: no decimal is made for each of very many rows."""
    return F.floor(column * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


PAIRS = f"""pairs AS (SELECT a.id AS q_id, p.*, p.x - a.x AS dx, p.y - a.y AS dy, p.z - a.z AS dz,
  sqrt((p.x-a.x)*(p.x-a.x) + (p.y-a.y)*(p.y-a.y) + (p.z-a.z)*(p.z-a.z)) AS d
  FROM fx_points p JOIN fx_annotations a ON sqrt((p.x-a.x)*(p.x-a.x) + (p.y-a.y)*(p.y-a.y) + (p.z-a.z)*(p.z-a.z)) <= {R})"""

COMPLEXITY = f"""WITH {PAIRS},
s AS (SELECT q_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x,x) AS cxx, covar_samp(y,y) AS cyy, covar_samp(z,z) AS czz,
      covar_samp(x,y) AS cxy, covar_samp(x,z) AS cxz, covar_samp(y,z) AS cyz FROM pairs GROUP BY q_id HAVING count(*) >= 10),
e1 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM s),
e2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM e1),
e3 AS (SELECT *, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz))/(2*p*p*p) AS rr FROM e2),
e4 AS (SELECT *, q + 2*p*cos(acos(greatest(-1e0, least(1e0, rr)))/3 + 2*pi()/3) AS l FROM e3),
e5 AS (SELECT *, cxy*cyz - cxz*(cyy-l) AS vx, cxz*cxy - (cxx-l)*cyz AS vy, (cxx-l)*(cyy-l) - cxy*cxy AS vz FROM e4),
e6 AS (SELECT *, vx/sqrt(vx*vx+vy*vy+vz*vz) AS pa, vy/sqrt(vx*vx+vy*vy+vz*vz) AS pb, vz/sqrt(vx*vx+vy*vy+vz*vz) AS pc FROM e5),
w AS (SELECT pairs.*, e6.n, e6.pa, e6.pb, e6.pc, abs(pa*(x-mx)+pb*(y-my)+pc*(z-mz)) AS away FROM pairs JOIN e6 USING (q_id)),
g AS (SELECT q_id, n, pa, pb, pc, avg(away) AS rugosity, count(*) FILTER (away <= 1e-2) AS inliers,
      CASE WHEN pa*avg(nx) FILTER (away <= 1e-2) + pb*avg(ny) FILTER (away <= 1e-2) + pc*avg(nz) FILTER (away <= 1e-2) < 0 THEN -1e0 ELSE 1e0 END AS turn
      FROM w GROUP BY q_id, n, pa, pb, pc)
SELECT q_id AS id, n, inliers, round(degrees(acos(greatest(-1e0, least(1e0, pc*turn)))), 3) + 0e0 AS elevation,
  round(((degrees(atan2(pa*turn, pb*turn)) + 360) % 360), 3) + 0e0 AS azimuth, round(degrees(atan(pa/pc)), 3) + 0e0 AS theta,
  round(degrees(atan(pb/pc)), 3) + 0e0 AS psi, round(rugosity, 5) AS rugosity FROM g"""


@query(COMPLEXITY, "fx_points", "fx_annotations")
def complexity_by_annotation(points, anns):
    """Plane angles and rugosity of the points around each annotation."""
    out = measures.plane_angles(measures.planes_at(points, anns, R)).where("n >= 10")
    return out.select(F.col("q_id").alias("id"), "n", "inliers", *(r(F.col(c), 3).alias(c) for c in ("elevation", "azimuth", "theta", "psi")), r(F.col("rugosity"), 5).alias("rugosity"))


@query(f"WITH {PAIRS} SELECT q_id AS id, point_id, round(d, 6) AS d FROM pairs", "fx_points", "fx_annotations")
def radius_subset(points, anns):
    """Points within a radius of each annotation."""
    return spatial.radius_points(points, anns, R).select("id", "point_id", scaled_round(F.col("d"), 6).alias("d"))


@query(f"WITH {PAIRS} SELECT q_id AS id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, point_id) AS k FROM pairs) WHERE k > 1", "fx_points", "fx_annotations")
def radius_subset_drop_nearest(points, anns):
    """The same without each annotation's nearest point."""
    return spatial.radius_points(points, anns, R, drop_nearest=True).select("id", "point_id")


@query("SELECT round(min(x),6) AS xmin, round(max(x),6) AS xmax, round(min(y),6) AS ymin, round(max(y),6) AS ymax, round(min(z),6) AS zmin, round(max(z),6) AS zmax FROM fx_points", "fx_points")
def bounding_box(points):
    """Least and greatest coordinates."""
    box = spatial.bounding_box(points)
    return box.select(*(r(F.col(c), 6).alias(c) for c in box.columns))


@query("SELECT point_id, round(x - avg(x) OVER (), 4) + 0e0 AS x, round(y - avg(y) OVER (), 4) + 0e0 AS y, round(z - avg(z) OVER (), 4) + 0e0 AS z FROM fx_points", "fx_points")
def centroid_shift(points):
    """Points about their centroid."""
    return orient.centroid_shift(points).select("point_id", *(r(F.col(a)).alias(a) for a in "xyz"))


@query("WITH s AS (SELECT point_id, x - 5e0 AS x, y - 2e0 AS y FROM fx_points) SELECT point_id, round(x - least(0e0, min(x) OVER ()), 6) + 0e0 AS x, round(y - least(0e0, min(y) OVER ()), 6) + 0e0 AS y FROM s", "fx_points")
def positive_xy_shift(points):
    """Points moved out of negative x and y."""
    moved = points.select("point_id", (F.col("x") - 5e0).alias("x"), (F.col("y") - 2e0).alias("y"))
    moved = moved.withColumn("z", F.lit(0.0))
    return orient.transform_points(moved, orient.positive_xy(moved)).select("point_id", *(r(F.col(a), 6).alias(a) for a in "xy"))


@query("""SELECT point_id, round(2e0*(cos(3e-1)*x - sin(3e-1)*y) + 1e0, 4) + 0e0 AS x, round(2e0*(sin(3e-1)*x + cos(3e-1)*y) - 2e0, 4) + 0e0 AS y,
  round(2e0*z + 5e-1, 4) + 0e0 AS z, round(cos(3e-1)*nx - sin(3e-1)*ny, 4) + 0e0 AS nx FROM fx_points""", "fx_points")
def apply_affine(points):
    """A chain of turn, scale and shift as one projection; normals only turn."""
    turn = t.axis_angle([0, 0, 1], 0.3)
    m = turn.then(t.scaling(2.0)).then(t.translation(1.0, -2.0, 0.5)).rows()
    return points.select("point_id", *(r(c).alias(a) for a, c in zip("xyz", affine(m), strict=True)), r(rotate(turn.rows())[0]).alias("nx"))


@query("""WITH a AS (SELECT *, cos(3e-1)*x - sin(3e-1)*y AS x1, sin(3e-1)*x + cos(3e-1)*y AS y1 FROM fx_points),
b AS (SELECT *, cos(2e-1)*x1 + sin(2e-1)*z AS x2, cos(2e-1)*z - sin(2e-1)*x1 AS z2 FROM a),
c AS (SELECT *, cos(1e-1)*y1 - sin(1e-1)*z2 AS y3, sin(1e-1)*y1 + cos(1e-1)*z2 AS z3 FROM b),
d AS (SELECT *, 15e-1*x2 - 2e0 AS x4, 15e-1*y3 + 1e0 AS y4, 15e-1*z3 - 125e-2 AS z4, 3e-1 AS ka, 2e-1 AS kb, sqrt(87e-2) AS kc, sqrt(91e-2) AS ks FROM c)
SELECT point_id, round((kb*z4 - kc*y4)/ks, 5) + 0e0 AS x, round(ks*x4 - (ka*kb*y4 + ka*kc*z4)/ks, 5) + 0e0 AS y, round(ka*x4 + kb*y4 + kc*z4, 5) + 0e0 AS z,
  round(x, 5) + 0e0 AS back_x, round(y, 5) + 0e0 AS back_y, round(z, 5) + 0e0 AS back_z FROM d""", "fx_points")
def transform_chain(points):
    """Turned by three angles, scaled, sunk by a depth, moved to an origin, a normal laid along z; and back by the inverse."""
    whole = t.identity().then(t.euler(0.1, 0.2, 0.3)).then(t.scaling(1.5)).then(t.depth_offset(1.25)).then(t.xy_origin(2.0, -1.0))
    whole = whole.then(t.align_normal_to_z((0.3, 0.2, math.sqrt(0.87))))
    moved = orient.transform_points(points, whole)
    return orient.original_coords(moved, whole).select("point_id", *(r(F.col(a), 5).alias(a) for a in "xyz"), *(r(F.col(f"orig_{a}"), 5).alias(f"back_{a}") for a in "xyz"))


@query("SELECT point_id, round(x*nx + y*ny + z*nz, 5) + 0e0 AS dot3, round(x*nx + y*ny + z*nz + 1e0, 5) + 0e0 AS dot4 FROM fx_points", "fx_points")
def vector_products(points):
    """Dot products of places and normals, plain and homogeneous."""
    a, b = ("x", "y", "z"), ("nx", "ny", "nz")
    return points.select("point_id", r(dot3(a, b), 5).alias("dot3"), r(dot4(a, b), 5).alias("dot4"))


@query("""WITH p AS (SELECT *, 3e-1 AS ka, 2e-1 AS kb, sqrt(87e-2) AS kc FROM fx_points)
SELECT point_id, round(x - (x*ka+y*kb+z*kc)*ka, 4) + 0e0 AS x, round(y - (x*ka+y*kb+z*kc)*kb, 4) + 0e0 AS y, round(z - (x*ka+y*kb+z*kc)*kc, 4) + 0e0 AS z FROM p""", "fx_points")
def project_on_plane(points):
    """Points projected onto a plane through the origin."""
    flat = on_plane((0.3, 0.2, math.sqrt(0.87)))
    return points.select("point_id", *(r(c).alias(a) for a, c in zip("xyz", flat, strict=True)))


@query("""WITH p AS (SELECT point_id, nx/sqrt(nx*nx+ny*ny+nz*nz) AS x, ny/sqrt(nx*nx+ny*ny+nz*nz) AS y, nz/sqrt(nx*nx+ny*ny+nz*nz) AS z FROM fx_points)
SELECT point_id, round(atan2(x, z), 5) + 0e0 AS beta, round(-atan2(y, sqrt(x*x+z*z)), 5) + 0e0 AS gamma, round(degrees(atan2(y, x)), 4) + 0e0 AS angle FROM p""", "fx_points")
def vector_angles(points):
    """Angles of the normals."""
    n = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    u = points.select("point_id", *((F.col(f"n{a}") / n).alias(a) for a in "xyz"))
    _, beta, gamma = zyx_angles("x", "y", "z")
    return u.select("point_id", r(beta, 5).alias("beta"), r(gamma, 5).alias("gamma"), r(vector_angle("y", "x")).alias("angle"))


@query("""WITH s AS (SELECT 5e-1*atan2(2*covar_samp(x,y), covar_samp(x,x)-covar_samp(y,y)) AS a FROM fx_points),
p AS (SELECT point_id, cos(a)*x + sin(a)*y AS x, cos(a)*y - sin(a)*x AS y, z FROM fx_points, s),
u AS (SELECT CASE WHEN corr(y, z) < 0 THEN -1e0 ELSE 1e0 END AS k FROM p), q AS (SELECT point_id, x*k AS x, y*k AS y, z FROM p, u)
SELECT point_id, round(x - least(0e0, min(x) OVER ()), 5) + 0e0 AS x, round(y - least(0e0, min(y) OVER ()), 5) + 0e0 AS y, round(z, 5) + 0e0 AS z FROM q""", "fx_points")
def orient_cloud(points):
    """Principal axis along X, +Y upslope, out of negative xy: one statistics pass, one bounds pass."""
    return orient.orient(points).select("point_id", *(r(F.col(a), 5).alias(a) for a in "xyz"))


@query(f"""WITH {PAIRS}, m AS (SELECT q_id, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b FROM pairs GROUP BY q_id)
SELECT q_id AS id, n, round(r,5) AS r, round(g,5) AS g, round(b,5) AS b, round(2126e-4*r + 7152e-4*g + 722e-4*b, 5) AS luminance FROM m""", "fx_points", "fx_annotations")
def rgb_stats(points, anns):
    """Median colours around each annotation."""
    out = measures.rgb_stats_at(points, anns, R)
    return out.select(F.col("q_id").alias("id"), "n", *(r(F.col(c), 5).alias(c) for c in ("r", "g", "b", "luminance")))


@query(f"""WITH {PAIRS}, s AS (SELECT q_id, count(*) AS n, sum(nx/sqrt(nx*nx+ny*ny+nz*nz)) AS sx, sum(ny/sqrt(nx*nx+ny*ny+nz*nz)) AS sy, sum(nz/sqrt(nx*nx+ny*ny+nz*nz)) AS sz FROM pairs GROUP BY q_id)
SELECT q_id AS id, n, round((n - sqrt(sx*sx+sy*sy+sz*sz))/nullif(n-1, 0), 5) AS dispersion FROM s""", "fx_points", "fx_annotations")
def vector_dispersion(points, anns):
    """Spread of the normals around each annotation."""
    out = measures.vector_dispersion_at(points, anns, R)
    return out.select(F.col("q_id").alias("id"), "n", r(F.col("dispersion"), 5).alias("dispersion"))


@query("""WITH b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS e FROM fx_points),
l AS (SELECT i, e*10001e-4/pow(2e0, i) AS s FROM b, range(10) t(i)),
c AS (SELECT i, s, count(DISTINCT (floor((x-x0)/s), floor((y-y0)/s), floor((z-z0)/s))) AS k FROM fx_points, b, l GROUP BY i, s)
SELECT round(regr_slope(ln(k), -ln(s)), 4) AS dimension, max(k) AS most FROM c""", "fx_points")
def fractal_dimension(points):
    """Box-counting dimension of the cloud."""
    return measures.fractal_dimension(points).select(r(F.col("dimension")).alias("dimension"), "most")


GAP = f"""{PAIRS}, gp AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS norm, atan2(dy,dx) AS th, acos(dz/sqrt(dx*dx+dy*dy+dz*dz)) AS ph FROM pairs WHERE dz > 0),
px AS (SELECT *, greatest(0, least(199, CAST(trunc((ph*cos(th)+pi()/2)/pi()*200) AS INT))) AS px, greatest(0, least(199, CAST(trunc((ph*sin(th)+pi()/2)/pi()*200) AS INT))) AS py FROM gp)"""


@query(f"""WITH {GAP}, area AS (SELECT count(*) AS n FROM range(200) a(x), range(200) b(y) WHERE (x-100)*(x-100)+(y-100)*(y-100) <= 10000)
SELECT a.id, count(DISTINCT px*1000+py) AS covered, round((max(area.n) - count(DISTINCT px*1000+py))/(max(area.n)*1e0), 6) AS gap_raw FROM fx_annotations a CROSS JOIN area LEFT JOIN px ON px.q_id = a.id GROUP BY a.id""", "fx_points", "fx_annotations")
def gap_fraction_raw(points, anns):
    """Share of the sky image that no point covers; of an open sky that is all of it."""
    out = measures.gap_fraction_at(points, anns, R)
    return out.select(F.col("q_id").alias("id"), "covered", r(F.col("gap_raw"), 6).alias("gap_raw"))


@query(f"""WITH {GAP}, area AS (SELECT count(*) AS n FROM range(200) a(x), range(200) b(y) WHERE (x-100)*(x-100)+(y-100)*(y-100) <= 10000)
SELECT a.id, count(DISTINCT px*1000+py) AS covered, round((max(area.n) - count(DISTINCT px*1000+py))/(max(area.n)*1e0), 6) AS gap_raw FROM fx_annotations a CROSS JOIN area LEFT JOIN px ON px.q_id = a.id AND sqrt(px.dx*px.dx+px.dy*px.dy) <= 15e-2 GROUP BY a.id""", "fx_points", "fx_annotations")
def gap_fraction_within(points, anns):
    """The same over points within 15 cm in xy of each annotation."""
    out = measures.gap_fraction_at(points, anns, R, max_radius=0.15)
    return out.select(F.col("q_id").alias("id"), "covered", r(F.col("gap_raw"), 6).alias("gap_raw"))


@query(f"""WITH {GAP}, k AS (SELECT *, row_number() OVER (PARTITION BY q_id, px, py ORDER BY norm, point_id) AS rk FROM px)
SELECT q_id AS id, px, py, point_id, CAST(floor(r*255) AS INT) AS r, CAST(floor(g*255) AS INT) AS g, CAST(floor(b*255) AS INT) AS b FROM k WHERE rk = 1""", "fx_points", "fx_annotations")
def pixel_colours(points, anns):
    """The nearest point's colour in each pixel of the sky image."""
    return measures.pixel_colours_at(points, anns, R).withColumnRenamed("q_id", "id")


@query(f"""WITH {PAIRS}, s AS (SELECT q_id, dx/sqrt(dx*dx+dy*dy+dz*dz)/(1+dz/sqrt(dx*dx+dy*dy+dz*dz))*5e-1 AS sx, dy/sqrt(dx*dx+dy*dy+dz*dz)/(1+dz/sqrt(dx*dx+dy*dy+dz*dz))*5e-1 AS sy FROM pairs WHERE dz > 0),
k AS (SELECT i, j, -5e-1 + i*1e-2 AS x, -5e-1 + j*1e-2 AS y FROM range(101) a(i), range(101) b(j)), n AS (SELECT * FROM k WHERE x*x+y*y <= 25e-2 + 1e-12),
w AS (SELECT DISTINCT q_id, CAST(round((sx + 5e-1)/1e-2) AS INT) + u.di AS i, CAST(round((sy + 5e-1)/1e-2) AS INT) + v.dj AS j, sx, sy FROM s, (VALUES (-1), (0), (1)) u(di), (VALUES (-1), (0), (1)) v(dj)),
c AS (SELECT DISTINCT q_id, n.i, n.j FROM w JOIN n ON n.i = w.i AND n.j = w.j AND (x-sx)*(x-sx)+(y-sy)*(y-sy) <= 1e-4), t AS (SELECT count(*) AS total FROM n)
SELECT a.id, t.total, count(c.i) AS covered, round(count(c.i)/(t.total*1e0), 6) AS cover FROM fx_annotations a CROSS JOIN t LEFT JOIN c ON a.id = c.q_id GROUP BY a.id, t.total""", "fx_points", "fx_annotations")
def canopy_cover(points, anns):
    """Share of the hemisphere's base grid near a projected point."""
    return measures.canopy_cover(points, anns, R, measures.CANOPY_SPACING).select("id", "total", "covered", r(F.col("cover"), 6).alias("cover"))


# the same query by its name of the last round
QUERIES["canopy_cover_fine"], SQL["canopy_cover_fine"] = QUERIES["canopy_cover"], SQL["canopy_cover"]


ZC = "zc AS (SELECT a.id, a.x AS ax, a.y AS ay, p.point_id, p.x, p.y, p.z, median(p.z) OVER (PARTITION BY a.id) AS mz, count(*) OVER (PARTITION BY a.id) AS n FROM fx_annotations a JOIN fx_points p ON sqrt((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y)) <= {r})"


@query(f"""WITH {ZC.format(r="2e-1")}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-mz)*(z-mz)), point_id) AS rk FROM zc)
SELECT id, n, point_id, round(mz, 5) AS median_z, round(z, 5) AS z FROM k WHERE rk = 1""", "fx_points", "fx_annotations")
def z_intercept(points, anns):
    """The surface point under each annotation's xy."""
    return spatial.z_intercept(points, anns.select("id", "x", "y"), 0.2).select("id", "n", "point_id", r(F.col("median_z"), 5).alias("median_z"), r(F.col("z"), 5).alias("z"))


@query("""WITH d AS (SELECT a.id, a.x AS ax, a.y AS ay, p.point_id, p.x, p.y, p.z, sqrt((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y)) AS d FROM fx_annotations a, fx_points p),
m AS (SELECT id, greatest(1e0, ceil(min(d)/5e-2))*5e-2 AS reach FROM d GROUP BY id),
c AS (SELECT d.*, m.reach, median(z) OVER (PARTITION BY d.id) AS mz FROM d JOIN m USING (id) WHERE d.d <= m.reach),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-mz)*(z-mz)), point_id) AS rk FROM c)
SELECT id, reach > 5e-2 AS is_extrapolated, round(CASE WHEN reach > 5e-2 THEN ax ELSE x END, 5) AS x, round(CASE WHEN reach > 5e-2 THEN ay ELSE y END, 5) AS y, round(CASE WHEN reach > 5e-2 THEN mz ELSE z END, 5) AS z FROM k WHERE rk = 1""", "fx_points", "fx_annotations")
def z_intercept_extrapolated(points, anns):
    """The same with a small radius that grows where nothing is near."""
    out = spatial.z_intercept_always(points, anns.select("id", "x", "y"), 0.05)
    return out.select("id", "is_extrapolated", *(r(F.col(a), 5).alias(a) for a in "xyz"))


@query("""WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points),
n AS (SELECT i AS ix, j AS iy, x0 + i*5e-1 AS nx, y0 + j*5e-1 AS ny FROM b, range(30) a(i), range(30) c(j) WHERE i < ceil((x1-x0)/5e-1) AND j < ceil((y1-y0)/5e-1)),
d AS (SELECT ix, iy, point_id, sqrt((x-n.nx)*(x-n.nx)+(y-n.ny)*(y-n.ny)) AS d FROM n, fx_points p),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, point_id) AS rk FROM d)
SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, point_id, round(d, 5) AS d FROM k WHERE rk = 1""", "fx_points")
def grid_intercept(points):
    """The nearest point to every vertical ray of a grid, however far."""
    return spatial.grid_intercept(points, 0.5).select("ix", "iy", "point_id", r(F.col("d"), 5).alias("d"))


@query("""WITH mk AS (SELECT pos, x, y, z FROM fx_annotations), sg AS (SELECT *, lead(x) OVER (ORDER BY pos) AS x2, lead(y) OVER (ORDER BY pos) AS y2, lead(z) OVER (ORDER BY pos) AS z2 FROM mk)
SELECT pos, CAST(k AS INT) AS k, round(x + (x2-x)*k/49, 5) AS x, round(y + (y2-y)*k/49, 5) AS y, round(z + (z2-z)*k/49, 5) AS z FROM sg, range(50) t(k) WHERE x2 IS NOT NULL""", "fx_annotations")
def transect_points(anns):
    """Points along the segments between markers."""
    return spatial.transect_points(anns).select("pos", "k", *(r(F.col(a), 5).alias(a) for a in "xyz"))


@query("""WITH mk AS (SELECT pos, x, y, z FROM fx_annotations), sg AS (SELECT *, lead(x) OVER (ORDER BY pos) AS x2, lead(y) OVER (ORDER BY pos) AS y2 FROM mk),
tp AS (SELECT x + (x2-x)*k/49 AS tx, y + (y2-y)*k/49 AS ty FROM sg, range(50) t(k) WHERE x2 IS NOT NULL),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points),
n AS (SELECT i AS ix, j AS iy, x0 + i*5e-1 AS nx, y0 + j*5e-1 AS ny FROM b, range(30) a(i), range(30) c(j) WHERE i < ceil((x1-x0)/5e-1) AND j < ceil((y1-y0)/5e-1)),
d AS (SELECT ix, iy, point_id, x, y, sqrt((x-n.nx)*(x-n.nx)+(y-n.ny)*(y-n.ny)) AS d FROM n JOIN fx_points p ON sqrt((x-n.nx)*(x-n.nx)+(y-n.ny)*(y-n.ny)) <= 25e-2),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, point_id) AS rk FROM d)
SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, point_id, round(min(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS d FROM k, tp WHERE rk = 1 AND sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)) <= 3e-1 GROUP BY ix, iy, point_id""", "fx_points", "fx_annotations")
def transect_sample(points, anns):
    """Grid intercepts near a transect."""
    return spatial.transect_sample(points, anns, 0.5, 0.3).select("ix", "iy", "point_id", r(F.col("d"), 5).alias("d"))


@query("SELECT a.id AS a, b.id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 5) AS d FROM fx_annotations a, fx_annotations b", "fx_annotations")
def distance_matrix(anns):
    """Distances of all annotations from each other."""
    return spatial.distance_matrix(anns).select("a", "b", scaled_round(F.col("d"), 5).alias("d"))


@query("SELECT id, x, y FROM fx_annotations UNION ALL SELECT label AS id, x, y FROM fx_targets", "fx_annotations", "fx_targets")
def appended(anns, targets):
    """Annotations and targets as one set; an id in both would be an error."""
    return an.append(anns.select("id", "x", "y"), targets.select(F.col("label").alias("id"), "x", "y"))


@query("SELECT cam_id, cx FROM fx_cameras WHERE starts_with(cam_id, 'cam_000')", "fx_cameras")
def cameras_by_prefix(cams):
    """Cameras by the beginning of their file name."""
    return an.by_prefix(cams, "cam_000", "cam_id").select("cam_id", "cx")


@query("SELECT id FROM fx_annotations WHERE starts_with(id, 'ann_0001')", "fx_annotations")
def subset_prefix(anns):
    """Annotations by id prefix."""
    return an.by_prefix(anns, "ann_0001").select("id")


@query("SELECT id FROM fx_annotations WHERE label = 'BUILDING'", "fx_annotations")
def subset_label(anns):
    """Annotations by label."""
    return an.by_label(anns, "BUILDING").select("id")


@query("SELECT id FROM fx_annotations ORDER BY pos LIMIT 5 OFFSET 3", "fx_annotations")
def subset_slice(anns):
    """Annotations 3 to 7 in order."""
    return an.by_range(anns, 3, 8).select("id")


@query("SELECT id FROM fx_annotations ORDER BY md5(id || ':1'), id LIMIT 7", "fx_annotations")
def random_subset_hash(anns):
    """Seven annotations in seeded order."""
    return an.random_subset(anns, 7).select("id")


@query("SELECT 'ann_' || lpad(CAST(max(CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 6, '0') AS next_id FROM fx_annotations", "fx_annotations")
def next_id(anns):
    """The id after the last one."""
    return an.next_id(anns)


_EXTRA = "SELECT id, pos*10 AS pos, x, y, z FROM fx_annotations UNION ALL SELECT id || '_left', pos*10+1, x-5e-2, y, z FROM fx_annotations UNION ALL SELECT id || '_right', pos*10+2, x+5e-2, y, z FROM fx_annotations UNION ALL SELECT 'orphan_left', 1, 0e0, 0e0, 0e0"


def _extra(anns):
    spark = anns.sparkSession
    own = anns.select("id", (F.col("pos") * 10).alias("pos"), "x", "y", "z")
    side = lambda name, k, d: anns.select(F.concat("id", F.lit(name)).alias("id"), (F.col("pos") * 10 + k).alias("pos"), (F.col("x") + d).alias("x"), "y", "z")
    orphan = spark.createDataFrame([("orphan_left", 1, 0.0, 0.0, 0.0)], own.schema)
    return own.unionByName(side("_left", 1, -0.05)).unionByName(side("_right", 2, 0.05)).unionByName(orphan)


@query(f"""WITH e AS ({_EXTRA}), s AS (SELECT *, replace(replace(id, '_left', ''), '_right', '') AS bare FROM e),
f AS (SELECT *, coalesce(max(CASE WHEN id = bare THEN 1 ELSE 0 END) OVER (PARTITION BY bare ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS is_extra FROM s)
SELECT id, pos, CASE WHEN is_extra THEN bare ELSE id END AS own_id, is_extra FROM f""", "fx_annotations")
def annotation_dedupe(anns):
    """Side rows told from annotations of their own."""
    return an.split_extra(_extra(anns)).select("id", "pos", "own_id", "is_extra")


@query(f"""WITH e AS ({_EXTRA}), s AS (SELECT *, replace(replace(id, '_left', ''), '_right', '') AS bare FROM e WHERE id <> 'orphan_left'), x AS (SELECT * FROM s WHERE id <> bare)
SELECT a.bare AS id, round(max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)))/2, 5) AS radius FROM x a JOIN x b ON a.bare = b.bare AND a.pos < b.pos GROUP BY a.bare""", "fx_annotations")
def extra_coords_radius(anns):
    """Half the largest distance of an annotation's side coordinates."""
    return an.extra_radius(an.split_extra(_extra(anns)).where("is_extra")).select("id", r(F.col("radius"), 5).alias("radius"))


_BARS = ", ".join(f"('{a}', '{b}', {c * 1000:.0f}e-3)" for a, b, c in an.SCALEBARS)


@query(f"""WITH bars(t1, t2, len) AS (VALUES {_BARS}), f AS (SELECT len/sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS f FROM bars JOIN fx_targets a ON a.label = t1 JOIN fx_targets b ON b.label = t2)
SELECT count(*) AS n, round(avg(f), 6) AS mean, round(var_pop(f), 6) AS variance, round(sqrt(var_pop(f))/sqrt(count(*)), 6) AS sterr FROM f""", "fx_targets")
def scale_factor(targets):
    """Scale from the bars between targets."""
    return an.scale_factor(targets).select("n", *(r(F.col(c), 6).alias(c) for c in ("mean", "variance", "sterr")))


CELLS = "o AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fx_points)"


@query(f"WITH {CELLS} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(x0+i, 5) AS xmin, round(y0+j, 5) AS ymin FROM o, range(20) a(i), range(20) b(j) WHERE i < ceil(x1-x0) AND j < ceil(y1-y0)", "fx_points")
def grid_cells(points):
    """One-metre cells over the cloud."""
    return grids.grid_cells(points, 1.0).select("i", "j", r(F.col("xmin"), 5).alias("xmin"), r(F.col("ymin"), 5).alias("ymin"))


SPREAD = f"""{CELLS}, c AS (SELECT CAST(floor((x-x0)/1e0) AS INT) AS i, CAST(floor((y-y0)/1e0) AS INT) AS j, x, y, x0, y0, x1, y1 FROM fx_points, o),
sb AS (SELECT i, j, CAST(floor((x-x0-i)/25e-2) AS INT) AS m, CAST(floor((y-y0-j)/25e-2) AS INT) AS n, count(*) AS k FROM c WHERE x0+i < x1 AND y0+j < y1 GROUP BY ALL),
sp AS (SELECT i, j, count(*) AS filled FROM sb WHERE k >= {{k}} GROUP BY i, j HAVING count(*) >= 8)"""


@query(f"WITH {SPREAD.format(k=1)} SELECT i, j, filled FROM sp", "fx_points")
def spread_filter(points):
    """Cells that points fill widely enough."""
    return grids.spread_filter(points, 1.0, 4, 1, 0.5)


LARGEST = f"""WITH {SPREAD.format(k=1)}, cc(i, j, ri, rj) AS (SELECT i, j, i, j FROM sp UNION SELECT s.i, s.j, cc.ri, cc.rj FROM cc JOIN sp s ON abs(s.i-cc.i)+abs(s.j-cc.j) = 1),
lb AS (SELECT i, j, min(CAST(ri AS BIGINT)*2147483648 + rj) AS comp FROM cc GROUP BY i, j), n AS (SELECT comp, count(*) AS n FROM lb GROUP BY comp), b AS (SELECT comp FROM n ORDER BY n DESC, comp LIMIT 1)
SELECT i, j FROM lb WHERE comp = (SELECT comp FROM b)"""


@query(LARGEST, "fx_points")
def largest_component(points):
    """The largest edge-connected set of such cells."""
    from cairn.session import cut

    return grids.largest_component(cut(grids.spread_filter(points, 1.0, 4, 1, 0.5), "cells"))


@query("""SELECT pos AS box, CAST(i AS INT) AS i, CAST(j AS INT) AS j, floor(x) + i*25e-2 AS cxmin, floor(y) + j*25e-2 AS cymin
FROM fx_annotations, range(8) a(i), range(4) b(j)""", "fx_annotations")
def subdivide(anns):
    """A box of 2 x 1 m at each annotation cut into quarters of a metre."""
    low = {a: F.floor(a).cast("double") for a in "xy"}
    boxes = anns.select(F.col("pos").alias("box"), low["x"].alias("xmin"), low["y"].alias("ymin"), (low["x"] + 2.0).alias("xmax"), (low["y"] + 1.0).alias("ymax"))
    return grids.subdivide(boxes, 0.25).select("box", "i", "j", "cxmin", "cymin")


@query(f"""WITH {CELLS}, c AS (SELECT CAST(floor((x-x0)/1e0) AS INT) AS i, CAST(floor((y-y0)/1e0) AS INT) AS j, point_id FROM fx_points, o)
SELECT i, j, point_id FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY md5(CAST(point_id AS VARCHAR) || ':1'), point_id) AS k FROM c) WHERE k <= 5""", "fx_points")
def stratified_hash(points):
    """Up to five points of each cell in seeded order."""
    return grids.stratified(points, 1.0, 5).select("i", "j", "point_id")


@query(f"""WITH {CELLS}, bn AS (SELECT CAST(floor((x-x0)/1e-1) AS INT) AS i, CAST(floor((y-y0)/1e-1) AS INT) AS j, count(*) AS n FROM fx_points, o GROUP BY ALL),
st AS (SELECT i, j FROM range(200) a(i), range(100) b(j), o WHERE i <= floor((x1-x0)/1e-1)-9 AND j <= floor((y1-y0)/1e-1)-4)
SELECT CAST(st.i AS INT) AS i, CAST(st.j AS INT) AS j, CAST(sum(n) AS BIGINT) AS n FROM st JOIN bn ON bn.i BETWEEN st.i AND st.i+9 AND bn.j BETWEEN st.j AND st.j+4 GROUP BY st.i, st.j ORDER BY n DESC, i, j LIMIT 1""", "fx_points")
def best_box(points):
    """The box of 1 x 0.5 m that holds most points."""
    return grids.best_box(points, 1.0, 0.5, 0.1).select("i", "j", "n")


@query(f"""WITH {CELLS}, c AS (SELECT CAST(floor((x-x0)/25e-2) AS INT) AS ix, CAST(floor((y-y0)/25e-2) AS INT) AS iy, r, g, b, x0, x1, y0, y1 FROM fx_points, o)
SELECT iy, ix, count(*) AS n, round(avg(r),5) AS r, round(avg(g),5) AS g, round(avg(b),5) AS b FROM c WHERE ix < ceil((x1-x0)/25e-2) AND iy < ceil((y1-y0)/25e-2) GROUP BY iy, ix""", "fx_points")
def ortho_raster(points):
    """Mean colours from above."""
    return grids.raster(points, 0.25).select("iy", "ix", "n", *(r(F.col(c), 5).alias(c) for c in "rgb"))


@query("SELECT point_id FROM fx_points ORDER BY md5(CAST(point_id AS VARCHAR) || ':1'), point_id LIMIT 1000", "fx_points")
def decimate_hash(points):
    """A thousand points in seeded order."""
    return grids.decimate(points, 1000).select("point_id")


@query("SELECT id, round(sqrt((pos*1e0)/pi())/100, 8) AS radius FROM fx_annotations", "fx_annotations")
def radius_from_surface(anns):
    """The radius of a disc of given area."""
    return anns.select("id", r(radius_from_area(F.col("pos").cast("double")), 8).alias("radius"))


@query("SELECT point_id, round(greatest(-1e-1, least(1e-1, nx)), 5) + 0e0 AS c FROM fx_points WHERE abs(-3e-1*x - 1e-1*y + z - 5e-2) <= 1e-2", "fx_points")
def plane_inliers(points):
    """Points within a hundredth of a given plane, with a clipped normal."""
    return measures.plane_inliers(points, (-0.3, -0.1, 1.0, -0.05), 0.01).select("point_id", r(clip(F.col("nx"), -0.1, 0.1), 5).alias("c"))


def lit(v: float) -> str:
    """A number that both engines read as a double."""
    return f"({v:.17e})"


LEAN = (0.2, -0.1, 0.95)
_TURN = t.up_vector(LEAN).rows()
_TURNED = "tp AS (SELECT *, " + ", ".join(f"{lit(m[0])}*x + {lit(m[1])}*y + {lit(m[2])}*z AS p{a}" for a, m in zip("xy", _TURN, strict=False)) + " FROM fx_points)"


def nodes(table: str, step: str) -> str:
    """CTE `n`: nodes of a grid over a table's box."""
    return f"""b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {table}),
n AS (SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, x0 + i*{step} AS gx, y0 + j*{step} AS gy FROM b, range(50) a(i), range(50) c(j) WHERE i < ceil((x1-x0)/{step}) AND j < ceil((y1-y0)/{step}))"""


@query(f"""WITH {_TURNED}, {nodes("fx_points", "5e-1")}, d AS (SELECT ix, iy, point_id, sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy)) AS d FROM n JOIN tp ON sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy)) <= 25e-2),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, point_id) AS rk FROM d) SELECT ix, iy, point_id, round(d, 5) AS d FROM k WHERE rk = 1""", "fx_points")
def grid_raycast(points):
    """The point nearest to each slanted ray of a grid."""
    return spatial.grid_raycast(points, 0.5, LEAN).select("ix", "iy", "point_id", r(F.col("d"), 5).alias("d"))


_LINE = """sg AS (SELECT *, lead(x) OVER (ORDER BY pos) AS x2, lead(y) OVER (ORDER BY pos) AS y2, lead(z) OVER (ORDER BY pos) AS z2 FROM fx_annotations),
tl AS (SELECT x + (x2-x)*k/49 AS tx, y + (y2-y)*k/49 AS ty, z + (z2-z)*k/49 AS tz FROM sg, range(50) t(k) WHERE x2 IS NOT NULL)"""


@query(f"""WITH {_LINE}, {nodes("fx_annotations", "5e-1")}, d AS (SELECT ix, iy, point_id, x, y, sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy)) AS d FROM n JOIN fx_points ON sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy)) <= 5e-1),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, point_id) AS rk FROM d)
SELECT ix, iy, point_id, round(min(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS d FROM k, tl WHERE rk = 1 AND sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)) <= 3e-2 GROUP BY ix, iy, point_id""", "fx_points", "fx_annotations")
def transect_raycast(points, anns):
    """Rays over the markers' box that meet a point within a step, near the transect."""
    return spatial.transect_raycast(points, anns, 0.5, 0.03).select("ix", "iy", "point_id", r(F.col("d"), 5).alias("d"))


@query(f"""WITH {_LINE}, {nodes("fx_points", "25e-2")}, d AS (SELECT ix, iy, point_id, x, y, sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy)) AS d FROM n JOIN fx_points ON sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy)) <= 1e-2),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, point_id) AS rk FROM d)
SELECT ix, iy, point_id, round(min(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS d FROM k, tl WHERE rk = 1 AND sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)) <= 3e-2 GROUP BY ix, iy, point_id""", "fx_points", "fx_annotations")
def transect_nearest(points, anns):
    """Points within a centimetre of a grid's nodes, near the transect."""
    return spatial.transect_nearest(points, anns, 0.25, 0.03).select("ix", "iy", "point_id", r(F.col("d"), 5).alias("d"))


@query("""WITH o AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fx_points),
h AS (SELECT i, j, k, x0 + i*1e0 AS xl, y0 + j*1e0 AS yl, md5(i || ':' || j || ':' || k || ':1') AS h FROM o, range(20) a(i), range(20) b(j), range(20) c(k) WHERE i < ceil(x1-x0) AND j < ceil(y1-y0)),
pl AS (SELECT i || '-' || j || '-' || k AS id, xl + CAST('0x' || substr(h, 1, 8) AS BIGINT)/4294967296e0*((xl+1e0)-xl) AS ax, yl + CAST('0x' || substr(h, 9, 8) AS BIGINT)/4294967296e0*((yl+1e0)-yl) AS ay FROM h),
s AS (SELECT id, ax, ay, median(z) AS az FROM pl JOIN fx_points ON sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)) <= 1e-1 GROUP BY id, ax, ay),
d AS (SELECT id, point_id, sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) AS d FROM s JOIN fx_points ON abs(x-ax) <= 5e-2 AND sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) <= 5e-2),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, point_id) AS rk FROM d) SELECT id, point_id, round(d, 5) AS d FROM k WHERE rk = 1""", "fx_points")
def stratified_raycast(points):
    """Random places of every cell dropped onto the surface and snapped to the nearest point."""
    places = grids.random_in_cells(grids.grid_cells(points, 1.0), 20).withColumn("id", F.concat_ws("-", "i", "j", "k"))
    return spatial.snapped(points, places, 0.1, 0.05).select("id", "point_id", r(F.col("d"), 5).alias("d"))


@query("""WITH s AS (SELECT covar_samp(x,x) AS cxx, covar_samp(y,y) AS cyy, covar_samp(z,z) AS czz, covar_samp(x,y) AS cxy, covar_samp(x,z) AS cxz, covar_samp(y,z) AS cyz FROM fx_points),
e1 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM s), e2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM e1),
e3 AS (SELECT *, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz))/(2*p*p*p) AS rr FROM e2),
e4 AS (SELECT *, q + 2*p*cos(acos(greatest(-1e0, least(1e0, rr)))/3) AS l FROM e3),
e5 AS (SELECT cyz*cxy - cxz*(cyy-l) AS vx, cxz*cxy - (cxx-l)*cyz AS vy, (cxx-l)*(cyy-l) - cxy*cxy AS vz FROM e4),
e6 AS (SELECT vx/sqrt(vx*vx+vy*vy+vz*vz) AS x, vy/sqrt(vx*vx+vy*vy+vz*vz) AS y, vz/sqrt(vx*vx+vy*vy+vz*vz) AS z FROM e5),
g AS (SELECT *, CASE WHEN greatest(abs(x), abs(y), abs(z)) = greatest(x, y, z) THEN 1e0 ELSE -1e0 END AS k FROM e6)
SELECT 'xy' AS plane, round(x*k, 5) + 0e0 AS ax, round(y*k, 5) + 0e0 AS ay, 0e0 AS az FROM g UNION ALL SELECT 'xz', round(x*k, 5) + 0e0, 0e0, round(z*k, 5) + 0e0 FROM g UNION ALL SELECT 'yz', 0e0, round(y*k, 5) + 0e0, round(z*k, 5) + 0e0 FROM g""", "fx_points")
def principal_axis(points):
    """The cloud's direction of most spread in the three planes."""
    of = lambda plane: measures.principal_axis(points, plane).select(F.lit(plane).alias("plane"), *(r(F.col(f"a{a}"), 5).alias(f"a{a}") for a in "xyz"))
    return of("xy").unionByName(of("xz")).unionByName(of("yz"))


@query("""WITH o AS (SELECT min(x) AS x0, min(y) AS y0 FROM fx_points)
SELECT CAST(floor((y-y0)/25e-2) AS INT) AS iy, CAST(floor((x-x0)/25e-2) AS INT) AS ix, count(*) AS n, CAST(floor(round(avg(r)*255, 6)) AS INT) AS r, CAST(floor(round(avg(g)*255, 6)) AS INT) AS g, CAST(floor(round(avg(b)*255, 6)) AS INT) AS b FROM fx_points, o GROUP BY ALL""", "fx_points")
def camera_raster(points):
    """The cloud as an orthographic picture."""
    return grids.camera_raster(points, 0.25)


@query("""WITH p AS (SELECT *, CAST(floor((x-2e0)/5e-2) AS INT) AS ix, CAST(floor((y-1e0)/5e-2) AS INT) AS iy FROM fx_points)
SELECT iy, ix, count(*) AS n, CAST(floor(round(avg(r)*255, 6)) AS INT) AS r, CAST(floor(round(avg(g)*255, 6)) AS INT) AS g, CAST(floor(round(avg(b)*255, 6)) AS INT) AS b FROM p WHERE ix BETWEEN 0 AND 99 AND iy BETWEEN 0 AND 99 GROUP BY ALL""", "fx_points")
def camera_raster_cropped(points):
    """The same cropped to a window, at least a hundred pixels a side."""
    return grids.camera_raster(points, 0.05, (2.0, 1.0, 5.0, 3.0))


_BACK = t.euler(0.1, -0.2, 0.3).then(t.scaling(1.5)).then(t.translation(1.0, 2.0, 3.0))


@query("SELECT point_id, x, y, z, 1e0 AS w, " + ", ".join(f"round({lit(m[0])}*x + {lit(m[1])}*y + {lit(m[2])}*z + {lit(m[3])}, 5) + 0e0 AS orig_{a}" for a, m in zip("xyz", _BACK.inverse().rows(), strict=False)) + " FROM fx_points", "fx_points")
def original_coords(points):
    """Where points were before a transform, and their homogeneous coordinates."""
    h = homogeneous()
    return orient.original_coords(points, _BACK).select("point_id", *(h[i].alias(a) for i, a in enumerate("xyzw")), *(r(F.col(f"orig_{a}"), 5).alias(f"orig_{a}") for a in "xyz"))


@query("SELECT point_id, " + ", ".join(f"round({lit(m[0])}*x + {lit(m[1])}*y + {lit(m[2])}*z, 5) + 0e0 AS {a}" for a, m in zip("xyz", _TURN, strict=False)) + " FROM fx_points", "fx_points")
def turn_to_vector(points):
    """Points turned so that a vector points up."""
    return orient.turn_to(points, LEAN).select("point_id", *(r(F.col(a), 5).alias(a) for a in "xyz"))


@query(COMPLEXITY.replace("SELECT q_id AS id, n, inliers,", "SELECT q_id AS id, n,").split("round(degrees(acos")[0] + f"""round(rugosity, 5) AS rugosity, round(dispersion, 5) AS dispersion, round(lum, 5) AS luminance FROM g JOIN
 (SELECT q_id AS qd, (count(*) - sqrt(pow(sum(nx/sqrt(nx*nx+ny*ny+nz*nz)), 2)+pow(sum(ny/sqrt(nx*nx+ny*ny+nz*nz)), 2)+pow(sum(nz/sqrt(nx*nx+ny*ny+nz*nz)), 2)))/nullif(count(*)-1, 0) AS dispersion,
  2126e-4*median(r) + 7152e-4*median(g) + 722e-4*median(b) AS lum FROM pairs GROUP BY q_id) m ON m.qd = g.q_id""", "fx_points", "fx_annotations")
def measure_all(points, anns):
    """Several measurements of each annotation's points, assigned to the annotations."""
    got = measures.measure_at(points, anns, R, ["rugosity", "dispersion", "rgb"])
    out = anns.join(got, F.col("id") == F.col("q_id")).where("rugosity_n >= 10")
    return out.select("id", F.col("rugosity_n").alias("n"), r(F.col("rugosity_rugosity"), 5).alias("rugosity"), r(F.col("dispersion_dispersion"), 5).alias("dispersion"), r(F.col("rgb_luminance"), 5).alias("luminance"))


@query("SELECT id FROM fx_annotations ORDER BY pos LIMIT 12", "fx_annotations")
def subset_first(anns):
    """The first twelve annotations."""
    return an.first(anns, 12).select("id")


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY pos DESC) AS k FROM fx_annotations) WHERE k BETWEEN 3 AND 9", "fx_annotations")
def subset_slice_from_the_end(anns):
    """Annotations by a slice that counts from the end."""
    return an.by_range(anns, -9, -2).select("id")


@query("""WITH o AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fx_points), e AS (SELECT (x1-x0)*(y1-y0) AS flat FROM o),
tr AS (SELECT point_id AS a, point_id + 1 AS b, point_id + 2 AS c FROM fx_points), v AS (SELECT q.x-p.x AS ux, q.y-p.y AS uy, q.z-p.z AS uz, w.x-p.x AS vx, w.y-p.y AS vy, w.z-p.z AS vz
 FROM tr JOIN fx_points p ON p.point_id = tr.a JOIN fx_points q ON q.point_id = tr.b JOIN fx_points w ON w.point_id = tr.c)
SELECT round(sum(sqrt((uy*vz-uz*vy)*(uy*vz-uz*vy)+(uz*vx-ux*vz)*(uz*vx-ux*vz)+(ux*vy-uy*vx)*(ux*vy-uy*vx))/2)/nullif(max(flat), 0), 4) AS rugosity FROM v, e""", "fx_points")
def rugosity_3d(points):
    """A mesh's area over that of the box it lies on."""
    tri = points.selectExpr("point_id AS t", "point_id AS a", "point_id + 1 AS b", "point_id + 2 AS c")
    area = measures.mesh_area(points.withColumnRenamed("point_id", "v"), tri)
    box = F.broadcast(spatial.bounding_box(points))  # one row
    flat = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return area.crossJoin(box).select(r(measures.rugosity_3d(flat, F.col("area"))).alias("rugosity"))


def _part(name: str) -> str:
    """The twin of another query, to be joined to."""
    return SQL[name]


@query("SELECT c.id, c.elevation, c.theta, c.psi, c.rugosity, g.gap_raw, m.luminance, m.dispersion, k.cm2 FROM (" + _part("complexity_by_annotation") + ") c LEFT JOIN (" + _part("gap_fraction_raw") + ") g USING (id) LEFT JOIN (" + _part("measure_all") + ") m USING (id) LEFT JOIN (SELECT id, round(pos/1e2, 4) AS cm2 FROM fx_annotations WHERE pos % 3 <> 0) k USING (id)", "fx_points", "fx_annotations")
def measure_by_name(points, anns):
    """All six measurements of the points around each annotation, by their names."""
    masks = anns.where("pos % 3 <> 0").select(F.col("id").alias("q_id"), (F.col("pos") / 1e2).alias("area_cm2"))
    got = measures.measure_at(points, anns, R, ["gap_fraction", "rgb", "rugosity", "dispersion", "mask_area", "plane_angles"], masks)
    got = anns.select("id").join(got.withColumnRenamed("q_id", "id"), "id").where("rugosity_n >= 10")
    return got.select("id", *(r(F.col(f"plane_angles_{c}"), 3).alias(c) for c in ("elevation", "theta", "psi")), r(F.col("rugosity_rugosity"), 5).alias("rugosity"), r(F.col("gap_fraction_gap_raw"), 6).alias("gap_raw"), r(F.col("rgb_luminance"), 5).alias("luminance"), r(F.col("dispersion_dispersion"), 5).alias("dispersion"), r(F.col("mask_area_cm2")).alias("cm2"))
