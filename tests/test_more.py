"""Cells of grids, alignment, bundles and vector statistics, against plain Python and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vectors as v
from orrery.operators import alignment, cells, spatial, stats
from orrery.sources import bundle, lines, poses

from .test_operators import cloud


def test_rays_cross_cells_in_order(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        o, d = rng.uniform(-3, 3, 3), rng.normal(size=3)
        if i % 3 == 0:
            o, d = np.round(o), np.array([[1, 0, 0], [0, -1, 0], [1, 1, 0], [1, -1, 1]][i // 3 % 4], float)  # along faces and through corners
        rows.append((i, (tuple(map(float, o)), tuple(map(float, d / np.linalg.norm(d)))), float(rng.uniform(0, 2)), float(rng.uniform(2, 9))))
    xyz = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"id long, ray struct<origin:{xyz},direction:{xyz}>, start double, stop double")
    for r in df.select("*", spatial.cells_along(F.col("ray"), F.col("start"), F.col("stop"), 0.7).alias("cells")).collect():
        o, d = np.array(r.ray.origin), np.array(r.ray.direction)
        seen = {(c.i, c.j, c.k) for c in r.cells}
        for t in np.linspace(r.start, r.stop, 400):
            u = (o + d * t) / 0.7
            near = {tuple(np.floor(u + e).astype(int)) for e in np.array(np.meshgrid(*[[-1e-9, 1e-9]] * 3)).reshape(3, -1).T}
            assert near & seen  # a point on a face is in one of the cells it parts
        assert len(r.cells) <= 3 + sum(abs(d) * (r.stop - r.start) / 0.7 + 1)


def test_cell_searches_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    grid = sorted({tuple(int(x) for x in c) for c in rng.integers(0, 9, (60, 3))})
    df = spark.createDataFrame(grid, "x int, y int, z int")
    low, size = (1.0, -2.0, 0.5), 0.5
    middle = {c: np.array(low) + size * np.array(c) for c in grid}
    asked = [tuple(map(float, x)) for x in [*rng.uniform(-3, 8, (40, 3)), middle[grid[0]], middle[grid[1]] + size / 2]]
    gap = lambda p, c: float(np.linalg.norm(np.maximum(np.abs(np.array(p) - middle[c]) - size / 2, 0)))
    for most in (None, 1.0):
        got = {r.point_id: ((r.x, r.y, r.z), r.distance) for r in cells.nearest_cells(cloud(spark, asked), df, size, low, most).collect()}
        for i, p in enumerate(asked):
            best = min((round(gap(p, c), 9), c) for c in grid)
            if most is None or best[0] <= most:
                assert abs(got[i][1] - best[0]) < 1e-8 and abs(gap(p, got[i][0]) - best[0]) < 1e-8
            else:
                assert i not in got
    rays = spark.createDataFrame([(i, p, (0.3, 0.9, 0.1)) for i, p in enumerate(asked)], "id long, o struct<x:double,y:double,z:double>, d struct<x:double,y:double,z:double>")
    rays = rays.select("id", g.ray(F.col("o"), F.col("d")).alias("ray"))
    d = np.array((0.3, 0.9, 0.1)) / np.linalg.norm((0.3, 0.9, 0.1))
    want = {}
    for i, p in enumerate(asked):
        for c in grid:
            a, b = (middle[c] - size / 2 - p) / d, (middle[c] + size / 2 - p) / d
            near, far = np.minimum(a, b).max(), np.maximum(a, b).min()
            if far >= 0 and near <= far:
                want[i, c] = near if near > 0 else far
    got = {(r.ray_id, (r.x, r.y, r.z)): r.distance for r in cells.cells_along_rays(rays, df, size, low).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got) and want
    assert cells.cells_along_rays(rays, df.limit(0), size, low).count() == 0
    assert cells.nearest_cells(cloud(spark, asked), df.limit(0), size, low).count() == 0


def test_points_are_counted_by_place(spark):
    points = cloud(spark, [(0, 0, 0)] * 50 + [(2, 2, 2)] * 3 + [(9, 9, 9)])
    boxes = spark.range(2).select("id", g.box(v.vec(-1.0, -1.0, -1.0), v.vec(1.0 + F.col("id"), 2.0, 2.0)).alias("box"))
    assert {r.box_id: r.n for r in spatial.count_points(points, boxes).collect()} == {0: 50, 1: 53}


@pytest.mark.parametrize("seed", range(3))
def test_scene_is_turned_upright(spark, seed):
    rng = np.random.default_rng(seed)
    tilt, turn = math.radians(rng.uniform(-30, 30)), math.radians(rng.uniform(-40, 40))
    rx = np.array([[1, 0, 0], [0, math.cos(tilt), -math.sin(tilt)], [0, math.sin(tilt), math.cos(tilt)]])
    rz = np.array([[math.cos(turn), -math.sin(turn), 0], [math.sin(turn), math.cos(turn), 0], [0, 0, 1]])
    scene = rx @ rz
    rows = []
    for axis, weight in ((2, 3.0), (0, 2.0), (1, 1.0)):
        for _ in range(200):
            n = scene[:, axis] * rng.choice([-1, 1]) + rng.normal(0, 0.01, 3)
            rows.append((tuple(map(float, n / np.linalg.norm(n))), weight))
    for _ in range(100):
        n = rng.normal(size=3)
        rows.append((tuple(map(float, n / np.linalg.norm(n))), 1.0))
    rows += [(None, 1.0), ((0.0, 0.0, 1.0), 0.0)]
    df = spark.createDataFrame(rows, "normal struct<x:double,y:double,z:double>, weight double")
    found = np.array(alignment.frame(df)).reshape(3, 3)
    assert np.allclose(found @ found.T, np.eye(3), atol=1e-9) and np.linalg.det(found) > 0
    left = np.abs(found @ scene)
    assert np.degrees(np.arccos(np.clip(left.max(axis=0), -1, 1))).max() < 0.7  # every axis of the scene is on one of the world's
    assert alignment.frame(df.limit(0)) == np.eye(3).ravel().tolist()
    moved = alignment.aligned(cloud(spark, [scene[:, 2]]), found.ravel().tolist()).first().pos
    assert abs(abs(moved.z) - 1) < 1e-3


def test_pose_and_vector_statistics(spark):
    rng = np.random.default_rng(1)
    xyz, angle, weight = rng.normal(size=(40, 3)), rng.uniform(2.8, 3.5, 40), rng.integers(1, 9, 40)
    df = cloud(spark, xyz).join(spark.createDataFrame([(i, float(a), int(w)) for i, (a, w) in enumerate(zip(angle, weight))], "id long, a double, w int"), "id")
    one = stats.pose_stats(df.withColumn("pose", g.pose(v.rotation_z(F.col("a")), F.col("pos")))).first()
    assert one.n == 40 and np.allclose(one.position, xyz.mean(axis=0)) and np.allclose(one.position_variance, xyz.var(axis=0, ddof=1))
    mean = math.atan2(np.sin(angle).mean(), np.cos(angle).mean())
    assert abs(one.angles.z - mean) < 1e-9 and abs(one.mean[0] - math.cos(mean)) < 1e-9
    assert stats.pose_stats(df.limit(0).withColumn("pose", g.pose(v.rotation_z(F.col("a")), F.col("pos")))).count() == 0
    got = stats.weighted_median_vector(df, "pos", "w").first().median
    for k, x in zip(got, xyz.T):
        order = np.argsort(x)
        assert math.isclose(k, x[order][np.argmax(np.cumsum(weight[order]) * 2 >= weight.sum())])
    assert np.allclose(df.agg(stats.mean_vector("pos", "w").alias("m")).first().m, np.average(xyz, axis=0, weights=weight))


def test_running_angles_are_folded_group_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k) if k else None, i, float(a)) for i, (k, a) in enumerate(zip(rng.integers(0, 5, 500), rng.uniform(-math.pi, math.pi, 500)))] + [(1, 900, None)]
    df = spark.createDataFrame(rows, "k long, i long, a double")

    def fold(values):
        n = mean = m2 = 0.0
        for x in values:
            d = (x - mean + math.pi) % (2 * math.pi) - math.pi
            mean, m2, n = mean + d / (n + 1), m2 + d * d * n / (n + 1), n + 1
        return n, mean, m2 / (n - 1) if n > 1 else 0.0

    got = {r.k: (r.n, r.mean, r.variance) for r in stats.circular_running(df, "a", "i", ["k"]).collect()}
    for k in (None, 1, 2, 3, 4):
        assert np.allclose(got[k], fold([a for q, _, a in rows if q == k and a is not None]))
    assert np.allclose(stats.circular_running(df, "a", "i").first(), fold([a for _, _, a in rows if a is not None]))
    assert stats.circular_running(df.limit(0), "a", "i", ["k"]).count() == 0


def test_bundle_tracks_and_json(spark, tmp_path):
    text = ["# Bundle file v0.3", "1 2", "500 0.1 0.2", "1 0 0", "0 1 0", "0 0 1", "1 2 3", "1 1 1", "9 8 7", "2 0 5 0 0 3 6 0 0", "2 2 2", "1 2 3", ""]
    lines.write_lines(spark.createDataFrame(list(enumerate(text)), "ord long, line string"), f"{tmp_path}/b", ["ord"], single=True)
    dots = sorted(bundle.read_bundle_points(spark, f"{tmp_path}/b").collect(), key=lambda r: r.idx)
    assert [(tuple(r.pos), tuple(r.color), r.cameras) for r in dots] == [((1, 1, 1), (9, 8, 7), [0, 3]), ((2, 2, 2), (1, 2, 3), [])]
    camera = bundle.read_bundle_cameras(spark, f"{tmp_path}/b").first()
    assert (camera.focal, camera.k1, camera.k2) == (500, 0.1, 0.2) and np.allclose(camera.pose, [1, 0, 0, -1, 0, 1, 0, -2, 0, 0, 1, -3])
    frames = spark.createDataFrame([("a.png", [float(i) for i in range(12)])], "file_path string, pose array<double>")
    bundle.write_transforms(frames, f"{tmp_path}/t", 48, 64, (5.0, 6.0, 7.0, 8.0))
    back = poses.read_transforms(spark, f"{tmp_path}/t").first()
    assert back.pose == [float(i) for i in range(12)] and (back.height, back.width, back.intrinsics.fy) == (48, 64, 6.0)
    crop = spark.range(1).select(v.vec(1.0, 2.0, 3.0).alias("center"), v.vec(4.0, 5.0, 6.0).alias("size"), F.array(*[F.lit(float(i)) for i in range(9)]).alias("orientation"))
    bundle.write_crop(crop, f"{tmp_path}/c")
    assert poses.read_crop(spark, f"{tmp_path}/c").first() == crop.first()
