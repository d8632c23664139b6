"""Reconstructed surfaces, rays through meshes and points spread over them."""

import math

import numpy as np
import pytest

from cairn.operators import mesh as m
from cairn.operators import reconstruct

POINT = "point_id long, x double, y double, z double, nx double, ny double, nz double"
TRIANGLE = "t long, " + ", ".join(f"{k}{x} double" for k in "abc" for x in "xyz")


def sphere(n):
    k = np.arange(n) + 0.5
    phi, theta = np.arccos(1 - 2 * k / n), math.pi * (1 + 5**0.5) * k
    p = np.stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)], 1)
    return [(i, *map(float, 2 * q), *map(float, q)) for i, q in enumerate(p)]


def test_poisson_mesh_of_a_sphere(spark):
    points = spark.createDataFrame(sphere(900), POINT)
    got = reconstruct.poisson_mesh(points, 4, trim=0.0, rounds=3).cache()
    found = reconstruct.surface_area(got).first()
    assert reconstruct.open_sides(got).count() == 0
    assert found.area == pytest.approx(16 * math.pi, rel=0.02)
    rows = got.collect()
    for r in rows:
        corners = [np.array([r[f"{k}{x}"] for x in "xyz"]) for k in "abc"]
        assert all(abs(np.linalg.norm(c) - 2) < 0.08 for c in corners)
        normal = np.cross(corners[1] - corners[0], corners[2] - corners[0])
        assert np.linalg.norm(normal) < 1e-9 or normal @ corners[0] > 0
    sides = 3 * found.triangles // 2
    assert len({r[k] for r in rows for k in "abc"}) - sides + found.triangles == 2


def test_blocks_come_to_the_field_of_one_block(spark, monkeypatch):
    points = spark.createDataFrame(sphere(300), POINT)

    def field():
        nodes, _, _, level = reconstruct.poisson_field(points, 4, 2)
        return {(r.i, r.j, r.k): r.x - level for r in nodes.where("w > 0").collect()}

    parts = field()
    monkeypatch.setattr(reconstruct, "BLOCK", 64)
    monkeypatch.setattr(reconstruct, "BORDER", 24)  # all nodes lie in each block
    whole = field()
    assert set(whole) == set(parts)
    assert max(abs(whole[n] - parts[n]) for n in whole) < 0.1 * max(map(abs, whole.values()))


def test_poisson_mesh_trims_and_bears_no_points(spark):
    points = spark.createDataFrame([], POINT)
    assert reconstruct.poisson_mesh(points, 4).count() == 0


def test_rays_meet_the_first_of_triangles_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(t, *map(float, (rng.random(3) * 4 - 2 + rng.random((3, 3)) * 2.0 ** rng.integers(-4, 3)).ravel())) for t in range(120)]
    rows.append((500, *[0.0] * 9))
    places = [(f"r{k}", *map(float, rng.random(2) * 4 - 2), 1.5) for k in range(80)] + [("corner", *rows[0][1:3], 9.0)]
    got = {r.id: (r.t, r.z) for r in m.cast_down(spark.createDataFrame(rows, TRIANGLE), spark.createDataFrame(places, "id string, x double, y double, z double")).collect()}
    want = {}
    for name, x, y, z in places:
        hits = []
        for t, ax, ay, az, bx, by, bz, cx, cy, cz in rows:
            a = np.array([[ax, bx, cx], [ay, by, cy], [1, 1, 1]])
            if abs(np.linalg.det(a)) > 1e-12:
                w = np.linalg.solve(a, [x, y, 1])
                if w.min() >= -1e-12 and (h := w @ [az, bz, cz]) <= z:
                    hits.append((-h, t))
        if hits:
            want[name] = min(hits)
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(-want[k][0]) for k in want)


def test_slanted_rays(spark):
    rows = [(1, -9.0, -9.0, 0.0, 9.0, -9.0, 0.0, 0.0, 9.0, 0.0)]
    rays = spark.createDataFrame([("a", 1.0, 0.0, 2.0)], "id string, x double, y double, z double")
    r = m.cast_along(spark.createDataFrame(rows, TRIANGLE), rays, (1.0, 0.0, 1.0)).first()
    assert (r.x, r.y, r.z) == pytest.approx((-1.0, 0.0, 0.0), abs=1e-9)


def square(side):
    return [(1, 0.0, 0.0, 0.0, side, 0.0, 0.0, side, side, 0.0), (2, 0.0, 0.0, 0.0, side, side, 0.0, 0.0, side, 0.0), (3, *[1.0] * 9)]


def test_samples_follow_area_and_keep_apart(spark):
    big = [(t, *r[1:]) for t, r in enumerate(square(3.0) + [(0, *[c + 10 for c in r[1:]]) for r in square(1.0)])]
    mesh = spark.createDataFrame(big, TRIANGLE)
    got = m.sample_uniform(mesh, 1000).collect()
    assert sorted(r.k for r in got) == list(range(1000))
    assert sum(r.x < 5 for r in got) == 900
    assert all(0 <= r.x <= 3 and 0 <= r.y <= 3 for r in got if r.x < 5)
    assert sorted(map(tuple, m.sample_uniform(mesh.repartition(5), 1000).collect())) == sorted(map(tuple, got))
    found, radius = m.sample_spread(spark.createDataFrame(square(2.0), TRIANGLE), 40)
    p = np.array([(r.x, r.y, r.z) for r in found.collect()])
    assert len(p) == 40 and radius > 0.8 * math.sqrt(4 / (2 * math.sqrt(3) * 40))
    assert min(np.linalg.norm(p[i] - p[j]) for i in range(40) for j in range(i)) >= radius
