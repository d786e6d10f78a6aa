"""Cameras, cross sections and the upright grid against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vectors as v
from orrery.operators import alignment, cameras, sections

LENS = "struct<fx:double,fy:double,cx:double,cy:double>"
CAMERAS = f"camera_id long, pose array<double>, intrinsics {LENS}"
TRIANGLES = "id long, a array<double>, b array<double>, c array<double>"


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def pose_of(rotation, at):
    return [float(x) for row, t in zip(rotation, at) for x in (*row, t)]


def triangles(spark, rows):
    point = lambda k: v.vec(*[F.get(k, F.lit(i)) for i in range(3)])
    return spark.createDataFrame([(i, *[list(map(float, p)) for p in t]) for i, t in enumerate(rows)], TRIANGLES).select("id", g.triangle(*[point(k) for k in "abc"]).alias("tri"))


def first_hit(origin, ray, shapes):
    best = (math.inf, None)
    for i, (a, b, c) in enumerate(shapes):
        m = np.stack([np.subtract(b, a), np.subtract(c, a), -ray], 1)
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        s, t, depth = np.linalg.solve(m, origin - a)
        if s > 0 and t > 0 and s + t < 1 and depth > 0:
            best = min(best, (depth, i))
    return best


@pytest.mark.parametrize("forward", [1.0, -1.0])
def test_render_equals_rays(spark, forward):
    rng = np.random.default_rng(5)
    views = [(turn(rng), rng.normal(size=3) * 0.5) for _ in range(4)]
    shapes = [rng.normal(size=(1, 3)) * 1.5 + rng.normal(size=(3, 3)) * s for s in (0.2, 0.5, 3.0) for _ in range(10)]  # large ones reach behind cameras
    rows = [(i, pose_of(r, t), (6.0, 7.0, 3.5, 2.5)) for i, (r, t) in enumerate(views)] + [(9, None, (1.0, 1.0, 0.0, 0.0))]
    got = cameras.render(spark.createDataFrame(rows, CAMERAS), triangles(spark, shapes), 8, 6, 4.0, forward).collect()
    want = {}
    for i, (rotation, at) in enumerate(views):
        for r in range(6):
            for c in range(8):
                depth, k = first_hit(at, rotation @ np.array([(c - 3.5) / 6, (r - 2.5) / 7, forward]), shapes)
                if depth <= 4:
                    want[i, r, c] = (k, depth)
    assert len(want) > 60
    assert {(x.camera_id, x.r, x.c): x.triangle_id for x in got} == {k: x for k, (x, _) in want.items()}
    assert all(abs(x.depth - want[x.camera_id, x.r, x.c][1]) < 1e-9 for x in got)


def test_against_mesh_and_bins(spark):
    shapes = [[(-5, -5, 2), (5, -5, 2), (0, 9, 2)]]
    camera = spark.createDataFrame([(1, pose_of(np.eye(3), (0, 0, 0)), (4.0, 4.0, 0.0, 0.0))], CAMERAS)
    measured = spark.createDataFrame([(1, 0, 0, 2.5), (1, 0, 3, 2.5), (1, 1, 1, 0.0), (1, 1, 2, None), (2, 0, 0, 1.0)], "camera_id long, r int, c int, depth double")
    found = cameras.against_mesh(measured, camera, triangles(spark, shapes), 4, 2, 10.0)
    got = {(x.camera_id, x.r, x.c): x for x in found.collect()}
    assert set(got) == {(1, 0, 0), (1, 0, 3), (2, 0, 0)}
    assert abs(got[1, 0, 0].accuracy - 0.5) < 1e-12 and got[1, 0, 0].angle == 0 and not got[2, 0, 0].hit
    assert abs(got[1, 0, 3].distance - 2.5) < 1e-9 and abs(got[1, 0, 3].angle - math.degrees(math.atan(0.75))) < 1e-6
    frames, total = cameras.accuracy_bins(found, 0.5, 10.0)
    assert sum(x.n for x in frames.collect()) == sum(x.n for x in total.collect()) == 2


def test_entry_cells_of_odd_cameras(spark):
    none = spark.createDataFrame([], CAMERAS)
    box = dict(width=4, height=4, resolution=1.0, low=(0.0, 0.0, 0.0), size=(4.0, 4.0, 4.0), shape=(5, 5, 5))
    assert cameras.entry_cells(none, **box).collect() == []
    down = pose_of(np.eye(3), (2, 2, 9))  # looks along -z; one ray runs parallel to the sides
    seen = cameras.entry_cells(spark.createDataFrame([(1, down, (50.0, 50.0, 1.0, 1.0)), (2, pose_of(np.eye(3), (2, 2, -9)), (50.0, 50.0, 1.0, 1.0))], CAMERAS), **box)
    assert {tuple(r) for r in seen.collect()} == {(2, 2, 4, 0, 0, -1)}
    inside = cameras.entry_cells(spark.createDataFrame([(1, pose_of(np.eye(3), (2, 2, 2)), (50.0, 50.0, 1.0, 1.0))], CAMERAS), **box)
    assert {tuple(r) for r in inside.collect()} == {(2, 2, 0, 0, 0, -1)}


def test_warp_covers_and_hides(spark):
    depths = spark.createDataFrame([(1, r, c, 1.0 if c < 2 else 2.0) for r in range(4) for c in range(4)] + [(1, 0, 0, None), (1, 0, 1, -1.0)], "camera_id long, r int, c int, depth double")
    camera = lambda f, m, x: spark.createDataFrame([(1, pose_of(np.eye(3), (x, 0, 0)), (f, f, m, m))], CAMERAS)
    same = cameras.warp(depths, camera(4.0, 1.5, 0.0), camera(4.0, 1.5, 0.0), 4, 4)
    assert {(x.r, x.c) for x in same.collect()} == {(r, c) for r in range(4) for c in range(4)}
    twice = cameras.warp(depths, camera(4.0, 1.5, 0.0), camera(8.0, 3.5, 0.0), 8, 8).collect()
    assert len(twice) == 64  # no holes
    moved = {(x.r, x.c): x.depth for x in cameras.warp(depths, camera(4.0, 1.5, 0.0), camera(4.0, 1.5, -0.5), 4, 4).collect()}
    assert moved[1, 2] == 1.0 and moved[1, 3] == 1.0  # the near half has moved before the far one


def test_outlines_of_a_ring_and_of_open_lines(spark):
    n = 12
    ring = [[math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)] for k in range(n)]
    tube = []
    for k in range(n):
        p, q = ring[k], ring[(k + 1) % n]
        tube += [[(*p, -1), (*q, -1), (*q, 1)], [(*p, -1), (*q, 1), (*p, 1)]]
    found = sections.chained(sections.section_lines(triangles(spark, tube), "z", 0.25)).orderBy("ord").collect()
    assert len(found) == 24 and {x.line for x in found} == {0} and all(x.closed for x in found) and [x.ord for x in found] == list(range(24))
    for a, b in zip(found, found[1:] + found[:1]):
        assert max(abs(a.end[k] - b.start[k]) for k in "xyz") < 1e-9
    part = sections.chained(sections.section_lines(triangles(spark, tube[2:8] + tube[14:18]), "z", 0.25)).collect()
    assert sorted([sum(x.line == k for x in part) for k in {x.line for x in part}]) == [4, 6] and not any(x.closed for x in part)
    assert sections.section_lines(triangles(spark, tube), "z", 5.0).count() == 0
    assert sections.chained(sections.section_lines(triangles(spark, tube), "z", 5.0)).collect() == []


def test_upright_by_clusters(spark):
    rng = np.random.default_rng(2)
    up = np.array([0.3, 0.1, 1.0])
    up /= np.linalg.norm(up)
    near = up + rng.normal(size=(400, 3)) * 0.004
    rows = [(list(map(float, s * n / np.linalg.norm(n))), 1.0) for n in near for s in (1, -1)]
    rows += [(list(map(float, n / np.linalg.norm(n))), 0.5) for n in rng.normal(size=(200, 3))]
    rows += [([float(-up[0]), float(up[1]), float(up[2])], 1.0)] * 5 + [(None, 1.0), ([0.0, 0.0, 1.0], None)]  # a mirrored one in the same cell
    normals = spark.createDataFrame(rows, "n array<double>, weight double").select(F.when(F.col("n").isNotNull(), v.vec(*[F.get("n", F.lit(i)) for i in range(3)])).alias("normal"), "weight")
    got = alignment.upright_by_clusters(normals).first()
    assert np.degrees(np.arccos(min(1, np.dot([got.x, got.y, got.z], up)))) < 0.5 and got.n < 1000
    cells = alignment.upright_cells(normals, (0.0, 0.0, 1.0), (1.0, 0.0, 0.0))
    assert alignment.main_clusters(cells).agg(F.max("removed")).first()[0] >= 5
    assert alignment.upright_by_clusters(normals.where("false")).collect() == []


def test_plane_errors(spark):
    rng = np.random.default_rng(3)
    normal = np.array([0.2, -0.1, -1.0]) / np.linalg.norm([0.2, -0.1, -1.0])
    rows, cloud = [], {}
    for r in range(12):
        for c in range(12):
            ray = np.array([(c - 5.5) / 10, (r - 5.5) / 10, 1.0])
            depth = float(normal @ np.array([0, 0, 2.0]) / (normal @ ray) + rng.normal() * 1e-3 + (0.8 if (r * 12 + c) % 9 == 0 else 0))
            rows.append((1, r, c, depth, "left" if c < 6 else "right"))
            cloud[r, c] = ray * depth
    depths = spark.createDataFrame([*rows, (1, 99, 0, 0.0, "left"), (1, 99, 1, None, "left")], "camera_id long, r int, c int, depth double, mask string")
    camera = spark.createDataFrame([(1, pose_of(np.eye(3), (0, 0, 0)), (10.0, 10.0, 5.5, 5.5))], CAMERAS)
    planes = spark.createDataFrame([(1,)], "camera_id long").select("camera_id", v.vec(0.0, 0.0, 2.0).alias("origin"), v.vec(*map(float, normal)).alias("normal"))
    got = {(x.r, x.c): x for x in cameras.against_plane(depths, camera, planes, ["mask"]).collect()}
    assert set(got) == set(cloud)
    for at, p in cloud.items():
        ray = p / np.linalg.norm(p)
        assert abs(got[at].accuracy - abs(normal @ (p - [0, 0, 2]))) < 1e-9
        assert abs(got[at].distance - normal @ [0, 0, 2] / (normal @ ray)) < 1e-9
        assert abs(got[at].angle - abs(np.degrees(np.arccos(normal @ ray)) - 180)) < 1e-6
    for mask, low in (("left", 0), ("right", 6)):
        pts = np.array([p for (r, c), p in cloud.items() if low <= c < low + 6])
        fitted = np.linalg.svd(pts - pts.mean(0))[2][2]
        for (r, c), p in cloud.items():
            if low <= c < low + 6:
                assert abs(got[r, c].noise - abs(fitted @ (p - pts.mean(0)))) < 1e-7
    firm = cameras.against_plane(depths, camera, planes, robust=True)
    rough = cameras.against_plane(depths, camera, planes)
    middle = lambda df: df.agg(F.median("noise")).first()[0]
    assert middle(firm) < 0.01 < middle(rough)
    stats = cameras.plane_statistics(rough, ["camera_id"]).first()
    assert stats.noise_n == stats.accuracy_n == 144
