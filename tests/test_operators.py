"""Direct computations that the SQL twins do not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import transforms as t
from cairn.operators import annotations as an
from cairn.operators import cameras as cam
from cairn.operators import grids, images, measures, orient, spatial
from cairn.operators.graph import components

POINT = "point_id long, x double, y double, z double"


def test_transforms():
    rng = np.random.default_rng(0)
    p = rng.random((5, 3))
    for up in ([0, 0, 1], [0, 0, -2], [1, 2, 3], [-1, 0, 0]):
        m = t.up_vector(up)
        assert np.allclose(m.apply(np.array(up) / np.linalg.norm(up)), [0, 0, 1]) and np.allclose(m.mat[:3, :3] @ m.mat[:3, :3].T, np.eye(3))
    n = np.array([0.2, -0.5, 0.8])
    n /= np.linalg.norm(n)
    first = np.cross([1, 0, 0], n) / np.linalg.norm(np.cross([1, 0, 0], n))
    assert np.allclose(t.align_normal_to_z(n).mat[:3, :3], [first, np.cross(n, first), n])
    steep = np.array([0.95, 0.2, 0.1]) / np.linalg.norm([0.95, 0.2, 0.1])
    assert np.allclose(t.align_normal_to_z(steep).mat[0, :3], np.cross([0, 1, 0], steep) / np.linalg.norm(np.cross([0, 1, 0], steep)))
    assert np.allclose(t.align_x((3, 4)).apply([3, 4, 9]), [5, 0, 9])
    both = t.euler(0.1, 0.2, 0.3).then(t.translation(1, 2, 3))
    assert np.allclose(both.then(both.inverse()).apply(p), p)
    assert np.allclose(t.euler(0.1, 0.2, 0.3).mat, t.axis_angle([1, 0, 0], 0.1).mat @ t.axis_angle([0, 1, 0], 0.2).mat @ t.axis_angle([0, 0, 1], 0.3).mat)
    assert t.dot4([1, 2, 3], [1, 2, 3]) == t.dot3([1, 2, 3], [1, 2, 3]) + 1
    with pytest.raises(ValueError):
        t.scaling(0)
    with pytest.raises(ValueError):
        t.Transform(np.eye(2))


def test_project_then_ray_gives_the_pixel_back(spark):
    cal = cam.Calibration(3000.0, 2900.0, 2000.0, 1500.0, 4000, 3000, -0.1, 0.02, -0.003, 0.001, -0.002)
    rng = np.random.default_rng(1)
    rows = [(i, "c", 0, *map(float, (rng.random(3) - [0.5, 0.5, 0]) * [2, 1.5, 0.3]), 0.0, 0.0, 4.0) for i in range(60)]
    df = spark.createDataFrame(rows, "ann_id int, cam_id string, cam_pos int, x double, y double, z double, cx double, cy double, cz double")
    seen = cam.project(cam.with_pose(df, [[1, 0, 0], [0, -1, 0], [0, 0, -1]]), cal)
    for r in cam.pixel_rays(seen, cal).collect():
        to = np.array([r.x - r.cx, r.y - r.cy, r.z - r.cz])
        assert np.linalg.norm(to / np.linalg.norm(to) - [r.rx, r.ry, r.rz]) < 4e-4  # half a pixel


def literal_ray(points, o, end, radius, most):
    o, end = np.array(o), np.array(end)
    length = np.linalg.norm(end - o)
    if length < radius:
        at = [0.0]
    else:
        at = [k * radius for k in range(int(length // radius))]
        if at[-1] < length:
            at.append(length)
    samples = [o + a * (end - o) / length for a in at]
    near = [min((float(np.linalg.norm(p - s)), i) for i, p in enumerate(points)) for s in samples]
    r = radius
    while True:
        for d, i in near:
            if d <= r:
                return i
        if r > most:
            return None
        r += radius


@pytest.mark.parametrize(("radius", "most"), [(0.05, 0.1), (0.03, 0.1), (0.2, 0.1)])
def test_ray_intercept_against_the_literal_loop(spark, radius, most):
    rng = np.random.default_rng(7)
    pts = rng.random((80, 3))
    rays = [(i, *map(float, rng.random(3) * 2 - 0.5), *map(float, rng.random(3))) for i in range(25)]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], POINT)
    got = {r.id: r.point_id for r in spatial.ray_intercept(points, spark.createDataFrame(rays, "id int, ox double, oy double, oz double, tx double, ty double, tz double"), radius, most).collect()}
    want = {r[0]: literal_ray(pts, r[1:4], r[4:], radius, most) for r in rays}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_bucket_join_equals_theta_join(spark):
    rng = np.random.default_rng(3)
    pts, qs = rng.random((200, 3)) * 4 - 2, rng.random((30, 3)) * 4 - 2
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], POINT)
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(qs)], POINT.replace("point_id", "id"))
    for radius in (0.1, 0.7, 3.0):
        got = {(r.q_id, r.point_id) for r in spatial.near(points, queries, radius).collect()}
        assert got == {(i, j) for i, q in enumerate(qs) for j, p in enumerate(pts) if np.linalg.norm(p - q) <= radius}
    best = {r.id: r.point_id for r in spatial.nearest(points, queries, 0.05, ["id"]).collect()}
    assert best == {i: int(np.argmin(np.linalg.norm(pts - q, axis=1))) for i, q in enumerate(qs)}


def test_planes_of_degenerate_clouds(spark):
    rows = [("one", 0, 1.0, 1.0, 1.0), *(("line", i, float(i), 0.0, 0.0) for i in range(5)), *(("wall", i, 0.0, float(i % 3), float(i // 3)) for i in range(9)), *(("same", i, 2.0, 2.0, 2.0) for i in range(3))]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 1.0) for r in rows], "q_id string, point_id int, x double, y double, z double, nx double, ny double, nz double")
    got = {r.q_id: r for r in measures.planes(df).collect()}
    assert set(got) == {"one", "line", "wall", "same"}
    assert abs(abs(got["wall"].a) - 1) < 1e-9 and got["wall"].rugosity < 1e-9
    assert got["one"].a is None and got["same"].a is None


def test_ransac_finds_the_plane(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(0.5 * x - 0.2 * y + 1 if i % 4 else rng.random() * 5)) for i, (x, y) in enumerate(rng.random((300, 2)))]
    best = measures.ransac_plane(spark.createDataFrame(rows, POINT), 80).first()
    assert best.inliers >= 225 and abs(abs(best.a / best.c) - 0.5) < 1e-6


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 100)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_orientation_is_rigid_and_upslope(spark):
    rng = np.random.default_rng(2)
    p = rng.random((200, 3)) * [8, 2, 0.1]
    p[:, 2] -= 0.4 * p[:, 1]
    p = t.axis_angle([0, 0, 1], 0.7).apply(p) - [3, 1, 0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], POINT)
    got = np.array([[r.x, r.y, r.z] for r in orient.orient(df).orderBy("point_id").collect()])
    assert np.allclose(np.linalg.norm(got[1:] - got[:-1], axis=1), np.linalg.norm(p[1:] - p[:-1], axis=1))
    assert got[:, 0].var() > got[:, 1].var() and np.corrcoef(got[:, 1], got[:, 2])[0, 1] > 0 and got[:, :2].min() > -1e-9


def test_append_refuses_a_second_id(spark):
    a, b = (spark.createDataFrame([(k, 1)], "id string, pos int") for k in ("p", "q"))
    assert an.append(a, b).count() == 2
    with pytest.raises(Exception, match="duplicate id"):
        an.append(a, a).collect()


def test_subdivide_refuses_uneven_boxes(spark):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.7)], "box int, xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(Exception, match="multiples"):
        grids.subdivide(boxes, 0.25).collect()


def test_random_in_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 2.0), (1, 0, 5.0, 0.0, 6.0, 2.0)], "i int, j int, xmin double, ymin double, xmax double, ymax double")
    got = grids.random_in_cells(cells, 200).collect()
    assert len(got) == 400 and all(5 * r.i <= r.x <= 5 * r.i + 1 and 0 <= r.y <= 2 for r in got)
    assert abs(np.mean([r.y for r in got]) - 1) < 0.15


def test_triangle_area(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0, 0.0)], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    assert math.isclose(row.select(measures.triangle_area("a", "b", "c")).first()[0], 6.0)


def test_crosshair_points_in_order(spark):
    n = np.array([0.3, -0.2, 0.9]) / np.linalg.norm([0.3, -0.2, 0.9])
    u = np.array([1.0, 0, 0]) - n[0] * n
    u /= np.linalg.norm(u)
    v = np.cross(n, u)
    row = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "id string, x double, y double, z double")
    got = np.array([[r.x, r.y, r.z] for r in cam.crosshair(row, (0.3, -0.2, 0.9), 0.02).orderBy("k").collect()])
    assert np.allclose(got, np.array([1, 2, 3]) + 0.02 * np.array([u, -u, v, -v]))


def test_depth_has_a_sign(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.1, -2.0, 0.0, 0.0, 4.0), (2, 0.1, 0.1, 9.0, 0.0, 0.0, 4.0)], "id int, x double, y double, z double, cx double, cy double, cz double")
    down = [[1, 0, 0], [0, -1, 0], [0, 0, -1]]
    got = {r.id: r.depth for r in cam.project(cam.with_pose(rows, down), CAL).collect()}
    assert got == {1: 6.0, 2: -5.0}
    assert cam.project(cam.with_pose(rows, down), CAL, require_front=True).count() == 1


CAL = cam.Calibration(3000.0, 3000.0, 2000.0, 1500.0, 4000, 3000)
DOWN = np.diag([1.0, -1.0, -1.0])


def tilted(k):
    return t.axis_angle([0, 1, 0], [0.0, 0.5, -1.2, 1.7][k % 4]).mat[:3, :3] @ DOWN


def cameras_of(spark, centres):
    rows = [(f"c{k}", k, *map(float, c), *(float(v) for r in range(3) for v in (*tilted(k)[r], c[r]))) for k, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cam_id string, pos int, cx double, cy double, cz double, " + ", ".join(f"{p} double" for p in cam.POSE))


def pixel(p, k, centre):
    q = tilted(k).T @ (np.asarray(p) - centre)
    if q[2] == 0:
        return None
    x, y = q[:2] / q[2]
    u, v = 3000 * x + 2000, 3000 * y + 1500
    if (x * x + y * y) * 9e6 < 1.01 * 16e6 and 0 <= u <= 4000 and 0 <= v <= 3000:
        return round(u), round(v), q[2], abs((abs(q[2]) + np.sum((centre - p) ** 2)) / 9e6) * (10 + abs(u - 2000) + abs(v - 1500))


def surface(n, seed):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * [3, 2]
    return np.c_[xy, 0.2 * xy[:, 0] + rng.random(n) * 0.6]


CENTRES = np.array([[0.5, 0.5, 3], [2.5, 1.5, 3.2], [1.0, 1.0, 2.8], [2.0, 0.4, 3.1], [30.0, 0.0, 3.0]])


def test_footprints_lose_no_match(spark):
    pts = surface(40, 4)
    anns = spark.createDataFrame([(f"a{i}", *map(float, p)) for i, p in enumerate(pts)], "id string, x double, y double, z double")
    got = {(r.ann_id, r.cam_id): (r.u, r.v) for r in cam.candidates(anns, cameras_of(spark, CENTRES), CAL).collect()}
    want = {(f"a{i}", f"c{k}"): pixel(p, k, c)[:2] for i, p in enumerate(pts) for k, c in enumerate(CENTRES) if pixel(p, k, c)}
    assert got == want and len(want) > 40
    axis = DOWN[:, 2]
    dist = {r.cam_id: (r.n, r.camdist) for r in cam.cam_distance(anns, cameras_of(spark, CENTRES[:1]), 12.0).collect()}
    gaps = [np.linalg.norm(p - CENTRES[0]) for p in pts if (p - CENTRES[0]) @ axis / np.linalg.norm(p - CENTRES[0]) >= math.cos(math.radians(12))]
    assert dist["c0"][0] == len(gaps) and math.isclose(dist["c0"][1], np.mean(gaps) if gaps else 0.0)


def test_cameras_of_one_pose_are_met_once(spark):
    pts = surface(20, 7)
    anns = spark.createDataFrame([(f"a{i:02d}", *map(float, p)) for i, p in enumerate(pts)], "id string, x double, y double, z double")
    one = cameras_of(spark, CENTRES)
    twins = one.unionByName(one.withColumns({"cam_id": F.concat("cam_id", F.lit("_twin")), "pos": F.col("pos") + 7})).unionByName(one.withColumns({"cam_id": F.concat("cam_id", F.lit("_third")), "pos": F.col("pos") - 9}))
    assert cam.poses(twins).count() == 5 and cam.leading(twins, 2).count() == 10
    assert cam.pose_candidates(anns, twins, CAL).count() * 3 == cam.candidates(anns, twins, CAL).count()
    told = lambda rows: [(r.ann_id, r["rank"], r.cam_id, r.u, r.v) for r in rows.orderBy("ann_id", "rank").collect()]
    assert told(cam.best_candidates(anns, twins, CAL, 4)) == told(cam.ranked(cam.candidates(anns, twins, CAL), 4))
    want = {r.cam_id: (r.n, r.first) for r in cam.candidates(anns, twins, CAL).groupBy("cam_id").agg(F.count("*").alias("n"), F.min("ann_id").alias("first")).collect()}
    assert {r.cam_id: (r.n, r.first_id) for r in cam.seen_by_camera(anns, twins, CAL).collect()} == want and len(want) >= 9
    dist = {r.cam_id: (r.n, r.camdist) for r in cam.cam_distance(anns, twins, 12.0).collect()}
    assert len(dist) == 15 and dist["c0"] == dist["c0_twin"] == dist["c0_third"] and dist["c0"][0] > 0
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(surface(60, 6))], POINT)
    anns = anns.where("id < 'a03'")
    all_rays = cam.reprojection(cam.candidates(anns, twins, CAL), points, CAL, 0.05, 0.2, 6.0)
    assert told(cam.occluded_candidates(anns, twins, points, CAL, 4, 0.05, 0.2, 6.0)) == told(cam.ranked(all_rays, 4, occlusion=True))


def hit_of(pts, u, v, k, centre, radius, most, far):
    way = tilted(k) @ np.array([(u - 2000) / 3000, (v - 1500) / 3000, 1.0])
    way /= np.linalg.norm(way)
    return literal_ray(pts, centre, centre + far * way, radius, most)


def test_occlusion_and_pixels_against_the_literal_loop(spark):
    pts = surface(150, 6)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], POINT)
    marks = pts[:12] + np.where(np.arange(12)[:, None] % 3, [0, 0, 0.002], [0.08, 0.05, 0])
    anns = spark.createDataFrame([(f"a{i:02d}", *map(float, p)) for i, p in enumerate(marks)], "id string, x double, y double, z double")
    cams = cameras_of(spark, CENTRES)
    found = cam.reprojection(cam.candidates(anns, cams, CAL), points, CAL, 0.05, 0.2, 6.0)
    got = [(r.ann_id, r.cam_id, r.obstructed) for r in cam.ranked(found, occlusion=True).orderBy("ann_id", "rank").collect()]
    want = []
    for i, p in enumerate(marks):
        rows = []
        for k, c in enumerate(CENTRES):
            at = pixel(p, k, c)
            hit = at and hit_of(pts, at[0], at[1], k, c, 0.05, 0.2, 6.0)
            if hit is not None and at and np.linalg.norm(pts[hit] - p) <= 0.5:
                rows.append((bool(np.linalg.norm(pts[hit] - p) >= 0.01), at[3], k))
        want += [(f"a{i:02d}", f"c{k}", far) for far, _, k in sorted(rows)]
    assert got == want and len({r[2] for r in got}) == 2
    pixels = [(f"{k}-{u}", u, v, k) for k in range(5) for u, v in ((900, 800), (2000, 1500), (3100, 2300))]
    at = spark.createDataFrame([r[:3] + (f"c{r[3]}",) for r in pixels], "id string, u int, v int, cam_id string").join(cams.select("cam_id", *cam.POSE), "cam_id")
    got = {r.id: r.point_id for r in cam.pixel_points(at, points, CAL, 0.05, 0.2, 6.0).collect()}
    want = {name: hit_of(pts, u, v, k, CENTRES[k], 0.05, 0.2, 6.0) for name, u, v, k in pixels}
    assert got == {n: h for n, h in want.items() if h is not None and pixel(pts[h], int(n[0]), CENTRES[int(n[0])])}


def test_visible_intercepts(spark):
    pts = np.array([[1.0, 1.0, 0.0], [1.0, 1.01, 0.5], [1.01, 1.0, 0.1], [2.0, 1.0, 0.3]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], POINT)
    queries = spark.createDataFrame([("q", 1.0, 1.0), ("r", 2.0, 1.0), ("s", 9.0, 9.0)], "id string, x double, y double")
    up = spark.createDataFrame([("c0", 0, 1.0, 1.0, 3.0, *(float(v) for r, c in zip(DOWN, [1.0, 1.0, 3.0], strict=True) for v in (*r, c)))], "cam_id string, pos int, cx double, cy double, cz double, " + ", ".join(f"{p} double" for p in cam.POSE))
    got = {r.id: (r.point_id, r.is_seen) for r in cam.visible_intercepts(points, queries, up, CAL, 0.1).collect()}
    assert set(got) == {"q", "r"} and got["r"] == (3, True) and got["q"][1]
    away = up.withColumn("m03", up.m03 + 500.0)
    assert {r.id: (r.point_id, r.is_seen) for r in cam.visible_intercepts(points, queries, away, CAL, 0.1).collect()} == {"q": (1, False), "r": (3, False)}


def test_nearest_gives_up_with_an_error(spark):
    points = spark.createDataFrame([(0, 100.0, 0.0, 0.0)], POINT)
    queries = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], POINT.replace("point_id", "id"))
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        spatial.nearest(points, queries, 0.05, ["id"], rounds=2)


def test_planes_at_equal_planes_of_pairs(spark):
    pts = surface(300, 9)
    points = spark.createDataFrame([(i, *map(float, p), 0.1, 0.0, 1.0) for i, p in enumerate(pts)], POINT + ", nx double, ny double, nz double")
    queries = spark.createDataFrame([(f"q{i}", *map(float, p)) for i, p in enumerate(pts[:8])], "id string, x double, y double, z double")
    a = {r.q_id: (r.n, r.inliers, r.a, r.d, r.rugosity) for r in measures.planes(spatial.near(points, queries, 0.6)).collect()}
    b = {r.q_id: (r.n, r.inliers, r.a, r.d, r.rugosity) for r in measures.planes_at(points, queries, 0.6).collect()}
    assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in a)
    deep = {(r.q_id, r.point_id) for r in spatial.near(points, queries, 0.3, deep=True).collect()}
    assert deep == {(r.q_id, r.point_id) for r in spatial.near(points, queries, 0.3).collect()}


def test_decimate_takes_the_first_in_seeded_order(spark):
    points = spark.range(500).withColumnRenamed("id", "point_id")
    order = [r.point_id for r in points.withColumn("h", grids.seeded("point_id")).orderBy("h", "point_id").collect()]
    for k in (0, 1, 77, 499, 500, 600):
        assert sorted(r.point_id for r in grids.decimate(points, k).collect()) == sorted(order[:k])


def literal_fill(pixels, n):
    r = n // 2
    image = np.array([[2 if (x, y) in pixels else int((x - r) ** 2 + (y - r) ** 2 <= r * r) for y in range(n)] for x in range(n)])
    for seed in ((r, r), (r, r // 2)):
        own, edge = image[seed], {seed}
        while edge:
            for i, j in edge:
                image[i, j] = 3 if own != 3 else image[i, j]
            edge = {(i + a, j + b) for i, j in edge for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= i + a < n and 0 <= j + b < n and image[i + a, j + b] == own and own != 3}
    return int((image == 3).sum())


def test_gap_fill_against_a_literal_fill(spark):

    rng = np.random.default_rng(3)
    pts = rng.random((900, 3)) * [1, 1, 0.5] - [0.5, 0.5, 0]
    pairs = spark.createDataFrame([("q", i, *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(pts)], "q_id string, point_id int, x double, y double, z double, q_x double, q_y double, q_z double")
    for n in (20, 40):
        pixels = {(r.px, r.py) for r in measures.gap_pixels(pairs, n).collect()}
        assert images.gap_fill(pairs, n).first().filled == literal_fill(pixels, n)


def test_gap_fill_of_many_images_at_once(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (count, height) in enumerate([(1, 0.9), (12, 0.2), (60, 0.5), (200, 0.3), (600, 0.6), (3000, 1.0)]):
        pts = rng.random((count, 3)) * [1, 1, height] - [0.5, 0.5, 0]
        rows += [(f"q{k}", i, *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(pts)]
    rows += [("seed", 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("seed", 1, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0)]  # the middle itself is covered
    pairs = spark.createDataFrame(rows, "q_id string, point_id int, x double, y double, z double, q_x double, q_y double, q_z double")
    for n in (21, 30):
        pixels = {}
        for p in measures.gap_pixels(pairs, n).select("q_id", "px", "py").collect():
            pixels.setdefault(p.q_id, set()).add((p.px, p.py))
        got = {p.q_id: p.filled for p in images.gap_fill(pairs, n).collect()}
        assert got == {q: literal_fill(own, n) for q, own in pixels.items()}
        runs = images.sky_runs(measures.gap_pixels(pairs, n), n).groupBy("q_id", "class").agg(F.sum("size").alias("size")).collect()
        assert {r.q_id: r["size"] for r in runs if r["class"] == images.COVERED} == {q: len(own) for q, own in pixels.items()}


def test_from_coords_and_samples(spark):
    got = an.from_coords(spark, {"p": (1, 2, 3), "none": None, "q": (4, 5, 6)}).orderBy("pos").collect()
    assert [(r.id, r.pos, r.z) for r in got] == [("p", 0, 3.0), ("q", 2, 6.0)]
    assert [r.id for r in an.from_coords(spark, [(0, 0, 0), None, (1, 1, 1)]).orderBy("pos").collect()] == ["0", "2"]
    with pytest.raises(ValueError, match="sample of 3"):
        an.random_subset(an.from_coords(spark, [(0, 0, 0)]), 3)


def test_measurements_by_name(spark):
    pairs = spark.createDataFrame([("q", 0, 0.0, 0.0, 1.0)], "q_id string, point_id int, nx double, ny double, nz double")
    measures.register("points", lambda p: p.groupBy("q_id").count())
    assert measures.measure(pairs, ["points"]).first().points_count == 1
    with pytest.raises(ValueError, match="no measurement"):
        measures.measure(pairs, ["nothing"])


def test_cell_area(spark):
    rows = [(i * 40 + j, i / 40, j / 40, 0.0, 0.0, 0.0, 1.0) for i in range(40) for j in range(40)]
    area = measures.cell_area(spark.createDataFrame(rows, POINT + ", nx double, ny double, nz double"), 0.1).first().area
    assert abs(area - 1.0) < 0.25


def test_an_open_sky_is_all_gap(spark):
    anns = spark.createDataFrame([("low", 0.0, 0.0, -1.0), ("high", 0.0, 0.0, 5.0)], "id string, x double, y double, z double")
    points = spark.createDataFrame([(1, 0.3, 0.0, 0.0, 0.0, 0.0, 1.0)], "point_id long, x double, y double, z double, nx double, ny double, nz double")
    pairs = spatial.radius_join(points, anns, 2.0)
    got = {r.q_id: r for r in measures.gap_fraction(pairs, 20, anns).collect()}
    assert got["high"].gap_raw == 1.0 and got["high"].covered == 0 and got["low"].covered == 1
    near = {r.q_id: r.gap_raw for r in measures.gap_fraction(pairs, 20, anns, max_radius=0.1).collect()}
    assert near == {"low": 1.0, "high": 1.0}
    filled = {r.q_id: r.filled for r in images.gap_fill(pairs, 20, anns).collect()}
    assert filled["high"] == measures.disc_pixels(20) == filled["low"] + 1


def test_every_grid_node_has_an_intercept(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 10.0, 0.0)], "point_id long, x double, y double, z double")
    got = spatial.grid_intercept(points, 1.0).collect()
    assert len(got) == 100 and {r.point_id for r in got if r.ix + r.iy < 10} == {1}
    assert spatial.grid_intercept(points, 1.0, 0.5).count() == 1


def test_a_pixel_in_a_widened_crop(spark):
    boxes = spark.createDataFrame([(10, 20, 29, 29, 100, 60, 15, 25)], "left int, top int, right int, bottom int, w int, h int, u int, v int")
    r = images.in_crop(images.mask_crop(boxes, 100, 100), 100, 100).first()
    assert (r.left, r.top, r.right, r.bottom, r.cu, r.cv) == (10, 14, 29, 33, 25, 55)
    with pytest.raises(ValueError):
        measures.measure(boxes, ["mask_area"])


def test_positive_xy_and_plane_inliers(spark):
    rows = spark.createDataFrame([(-2.0, 3.0, 1.0), (1.0, 4.0, -1.0), (0.0, 5.0, 1.5)], "x double, y double, z double")
    assert orient.positive_xy(rows).mat[:3, 3].tolist() == [2.0, 0.0, 0.0]
    assert orient.positive_xy(rows.where("x > 5")).mat.tolist() == orient.identity().mat.tolist()
    assert [tuple(r) for r in measures.plane_inliers(rows, (0.0, 0.0, 1.0, -1.0), 0.5).collect()] == [(-2.0, 3.0, 1.0), (0.0, 5.0, 1.5)]
    own = rows.selectExpr("*", "0D as a", "0D as b", "1D as c", "-z as d")
    assert measures.plane_inliers(own, ("a", "b", "c", "d"), 0.0).count() == 3


def test_pairs_at_home_stay_in_their_task(spark):
    rng = np.random.default_rng(3)
    rows = lambda n: [(i, *map(float, p)) for i, p in enumerate(rng.random((n, 3)) * [3, 2, 0.6] - 1)]
    points = spark.createDataFrame(rows(300), POINT)
    queries = spark.createDataFrame(rows(30), POINT.replace("point_id", "id"))
    for flat, width in ((False, None), (True, 0.3), (False, 0.11)):
        got = {(r.q_id, r.point_id, r.d) for r in spatial.near_at_home(points, queries, 0.3, flat, width).collect()}
        assert got == {(r.q_id, r.point_id, r.d) for r in spatial.near(points, queries, 0.3, flat).collect()} and len(got) > 30
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = spatial.near_at_home(points, queries, 0.3)
    counted = pairs.groupBy(*spatial.by_query(pairs)).agg(F.median("z"))
    assert plan(counted).count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan(counted)
    # what is repeated to 27 cells each is never broadcast
    assert "Broadcast" not in plan(spatial.near(points, queries, 0.3, deep=True)) and "Broadcast" not in plan(spatial.near_points(queries, points, 0.3))


def test_edges_in_order_are_contracted_before_the_rounds(spark):
    from cairn.operators.graph import contracted

    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(3000) if k % 700]
    loose = [(int(a), int(b)) for a, b in rng.integers(5000, 9000, (1500, 2))]
    edges = spark.createDataFrame(chain + loose + [(10, 6000)], "a long, b long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.node, r.comp) for r in components(edges, in_order=True).collect()}
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <= 3000")
        assert contracted(pairs)[1].count() < 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(r.node, r.comp) for r in components(edges).collect()} and len(got) > 4000


def test_transect_points_over_ranges_of_markers(spark):
    rows = [(k, float(k % 7), float(k % 5), float(k % 3)) for k in range(101)]
    markers = spark.createDataFrame(rows[::-1], "pos long, x double, y double, z double")
    plan = spatial.transect_points(markers, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(x" not in plan or "windowspecdefinition(pos" not in plan  # no task orders all markers
    got = {(p.pos, p.k): (p.x, p.y, p.z) for p in spatial.transect_points(markers, 3).collect()}
    want = {(a[0], k): tuple(u + (v - u) * k / 2 for u, v in zip(a[1:], b[1:], strict=True)) for a, b in zip(rows, rows[1:], strict=False) for k in range(3)}
    assert got == want
