"""Measures of neighbourhoods, tile by tile, equal those of written pairs."""

import numpy as np
import pytest

from cairn.operators import measures, spatial

FULL = "point_id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    xyz = rng.random((2500, 3)) * [5, 3, 0.4] - [2, 1, 0]
    points = [(i, *map(float, p), *map(float, rng.normal(size=3)), *map(float, rng.random(3))) for i, p in enumerate(xyz)]
    # repeated places, one far from all points, one on a point
    at = np.vstack([rng.random((60, 3)) * [5, 3, 0.4] - [2, 1, 0.1], np.full((3, 3), 0.25), [[90.0, 90.0, 0.0]], xyz[:1]])
    queries = spark.createDataFrame([(f"q{i}", *map(float, p)) for i, p in enumerate(at)], "id string, x double, y double, z double")
    return spark.createDataFrame(points, FULL), queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(got, want):
    assert set(got) == set(want) and len(got) > 50
    for k, v in want.items():
        assert np.allclose([np.nan if x is None else x for x in got[k]], [np.nan if x is None else x for x in v], equal_nan=True, atol=1e-9), k


def test_planes_without_written_pairs(tables):
    points, queries = tables
    rows = lambda df: {p.q_id: (p.n, p.mx, p.l1, p.l3, p.a, p.b, p.c, p.d, p.rugosity, p.inliers) for p in df.collect()}
    got = measures.planes_at(points, queries, 0.7)
    assert "Join" not in plan(got)
    same(rows(got), rows(measures.planes(spatial.near(points, queries, 0.7))))


def test_colours_and_dispersion(tables, monkeypatch):
    points, queries = tables
    pairs = spatial.near(points, queries, 0.7)
    rows = lambda df, *c: {p.q_id: tuple(p[k] for k in c) for p in df.collect()}
    got, want = measures.rgb_stats_at(points, queries, 0.7), ("n", "r", "g", "b", "luminance")
    assert "Join" not in plan(got)
    same(rows(got, *want), rows(measures.rgb_stats(pairs), *want))
    same(rows(measures.vector_dispersion_at(points, queries, 0.7), "n", "dispersion"), rows(measures.vector_dispersion(pairs), "n", "dispersion"))


def test_medians_of_grouped_values():
    from cairn.operators import neighbourhoods as nb

    rng = np.random.default_rng(2)
    values = rng.random(4 * nb.VALUES + 7)
    some = rng.permutation(len(values))
    add, done = nb.medians(["v"])(np.zeros((9, 3)), {"v": values})
    has = rng.random((9, len(some) - 50)) < np.linspace(0, 0.9, 9)[:, None]
    block = nb.Block(np.arange(9), np.zeros((9, 3)), some[:50], some[50:], has)
    add(block)
    assert np.allclose(done()["v"], [np.median(values[block.of(k)]) for k in range(9)])


def test_sky_images(tables):
    from cairn.operators import images

    points, queries = tables
    pairs = spatial.near(points, queries, 0.7)
    for most in (None, 0.2):
        got = measures.gap_fraction_at(points, queries, 0.7, 60, most)
        assert "Join" not in plan(got)
        same({p.q_id: (p.covered, p.gap_raw) for p in got.collect()}, {p.q_id: (p.covered, p.gap_raw) for p in measures.gap_fraction(pairs, 60, queries, most).collect()})
        got = images.gap_fill_at(points, queries, 0.7, 60, most).collect()
        same({p.q_id: (p.filled, p.gap_fill) for p in got}, {p.q_id: (p.filled, p.gap_fill) for p in images.gap_fill(pairs, 60, queries, most).collect()})
    key = lambda df: sorted(tuple(p[c] for c in ("q_id", "px", "py", "point_id", "r", "g", "b")) for p in df.collect())
    got = measures.pixel_colours_at(points, queries, 0.7, 60)
    assert key(got) == key(measures.pixel_colours(pairs, 60)) and "Join" not in plan(got)


def test_pairs_leave_tile_by_tile(tables):
    points, queries = tables
    for drop in (False, True):
        got = spatial.radius_points(points, queries, 0.7, drop)
        assert "Join" not in plan(got) and "Window" not in plan(got)
        want = sorted((p.q_id, p.point_id, p.d) for p in spatial.radius_join(points, queries, 0.7, drop).collect())
        assert sorted((p.id, p.point_id, p.d) for p in got.collect()) == want


def test_canopy_and_surface(tables, spark):
    points, queries = tables
    got = {p.id: p.covered for p in measures.canopy_cover(points, queries, 0.7, 0.05).collect()}
    xyz = np.array([tuple(p) for p in points.select("x", "y", "z").collect()])
    line = -0.7 + np.arange(29) * 0.05
    node = np.array([(x, y) for x in line for y in line if x * x + y * y <= 0.49 + 1e-12])
    for q in queries.collect():
        d = xyz - [q.x, q.y, q.z]
        norm = np.sqrt((d * d).sum(axis=1))
        d, norm = d[(norm <= 0.7) & (d[:, 2] > 0)], norm[(norm <= 0.7) & (d[:, 2] > 0)]
        s = d[:, :2] / (norm + d[:, 2])[:, None] * 0.7
        want = (((node[:, None] - s[None]) ** 2).sum(axis=2) <= 0.05 * 0.05).any(axis=1).sum() if len(s) else 0
        assert got[q.id] == want
    got = {p.id: (p.n, p.median_z, p.point_id, p.z) for p in spatial.z_intercept(points, queries, 0.3).collect()}
    ids = np.array([p.point_id for p in points.select("point_id").collect()])
    for q in queries.collect():
        far = np.sqrt((xyz[:, 0] - q.x) ** 2 + (xyz[:, 1] - q.y) ** 2) <= 0.3
        if not far.any():
            assert q.id not in got
            continue
        mid = np.median(xyz[far, 2])
        best = np.argmin(np.sqrt(((xyz[far] - [q.x, q.y, mid]) ** 2).sum(axis=1)))
        assert got[q.id][0] == far.sum() and np.isclose(got[q.id][1], mid) and got[q.id][2:] == (ids[far][best], xyz[far][best, 2])
    assert "Join" not in plan(spatial.z_intercept(points, queries, 0.3))


def test_several_measures_in_one_pass(tables):
    points, queries = tables
    names = ["rugosity", "gap_fraction", "dispersion", "rgb", "mask_area", "plane_angles"]
    masks = queries.selectExpr("id AS q_id", "x AS area_cm2")
    got = measures.measure_at(points, queries, 0.7, names, masks)
    assert plan(got).count("Join") == 1  # the masks
    want = measures.measure(spatial.near(points, queries, 0.7), names, masks)
    assert sorted(got.columns) == sorted(want.columns)
    key = [c for c in want.columns if c != "q_id" and not c.startswith("gap")]
    rows = lambda df: {p.q_id: tuple(p[c] for c in key) for p in df.collect()}
    same(rows(got), rows(want))


def test_lengths_round_without_decimals(spark):
    from pyspark.sql import functions as F

    from cairn.plans.points import scaled_round

    rows = spark.range(2000).select((F.rand(3) * 9).alias("d"))
    assert "round(" not in plan(rows.select(scaled_round(F.col("d"), 5).alias("v"))).lower()
    assert all(p.v == round(p.d, 5) for p in rows.select("d", scaled_round(F.col("d"), 5).alias("v")).collect())


def test_null_colours_and_normals_are_left_out(tables):
    from pyspark.sql import functions as F

    points, queries = tables
    odd = F.col("point_id") % 3 == 0
    some = points.withColumns({c: F.when(~odd, F.col(c)) for c in ("r", "nx", "ny", "nz")})
    pairs = spatial.near(some, queries, 0.7)
    rows = lambda df, *c: {p.q_id: tuple(p[k] for k in c) for p in df.collect()}
    same(rows(measures.rgb_stats_at(some, queries, 0.7), "n", "r", "g"), rows(measures.rgb_stats(pairs), "n", "r", "g"))
    same(rows(measures.vector_dispersion_at(some, queries, 0.7), "n", "dispersion"), rows(measures.vector_dispersion(pairs), "n", "dispersion"))
    same(rows(measures.planes_at(some, queries, 0.7), "n", "a", "b", "inliers"), rows(measures.planes(pairs), "n", "a", "b", "inliers"))
