"""Operators on edge cases, against plain Python and numpy."""

import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import scalars as s
from orrery.functions import vectors as v
from orrery.operators import association, binning, collections, grid, mesh, raster, relational, spatial, stats, voxel
from orrery.sources import images, lines, ply, points, poses

P = "id long, pos struct<x:double,y:double,z:double>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def cloud(spark, xyz):
    return spark.createDataFrame([(i, tuple(map(float, p))) for i, p in enumerate(xyz)], P)


# --- statistics -------------------------------------------------------------------------


def test_states_merge_like_the_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 7, 300), rng.normal(1e3, 5, 300))] + [(9, 4.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    merged = stats.merge_states(stats.describe(df, "x", ["k"])).first()
    whole = np.array([x for _, x in rows])
    assert merged.n == 301 and math.isclose(merged.mean, whole.mean()) and math.isclose(merged.variance, whole.var(ddof=1), rel_tol=1e-9)
    single = stats.describe(df.where("k = 9"), "x").first()
    assert single.variance == 0 and single.n == 1
    empty = stats.describe(df.where("k = 99"), "x").first()
    assert empty.n == 0 and empty.mean is None and empty.variance is None
    assert stats.merge_states(stats.describe(df.where("k = 99"), "x")).first().n == 0
    seeded = stats.describe(df.where("k = 9"), "x", seeded=True).first()
    assert seeded.min == 0 and seeded.max == 4


def test_circular_mean_wraps(spark):
    df = spark.createDataFrame([(i, math.radians(d)) for i, d in enumerate((359, 1, 358, 2))], "i long, a double")
    assert abs(df.agg(*stats.circular("a")).first()["mean"]) < 1e-9
    folded = stats.circular_running(df, "a", "i").first()
    assert abs(math.sin(folded["mean"])) < 1e-6 and folded.n == 4 and folded.variance < 0.002


def test_extremes_keep_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5), (None, 5), ("b", None)], "k string, x int")
    assert sorted((r.k or "", r.x) for r in stats.extremes(df, "x", ["k"]).collect()) == [("", 5), ("", 5), ("a", 1), ("a", 1)]
    assert stats.extremes(df.limit(0), "x").count() == 0
    assert stats.weighted_median(spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 8), (None, 9)], "v double, w int"), "v", "w").first()["median"] == 3.0


def test_plane_fit(spark):
    rng = np.random.default_rng(1)
    n = np.array([1, 2, -2]) / 3
    pts = rng.normal(size=(200, 3))
    pts = pts - np.outer(pts @ n, n) + 4 * n
    found = stats.fit_plane(spark.createDataFrame(pts.tolist(), "x double, y double, z double"), "x", "y", "z").first()
    assert abs(abs(np.dot(tuple(found.normal), n)) - 1) < 1e-9 and np.dot(tuple(found.normal), tuple(found.origin)) > 0


def test_bins_truncate_towards_zero(spark):
    df = spark.createDataFrame([(-1.7,), (-0.1,), (0.1,), (1.0,), (None,)], "v double")
    assert {r.bin: r.weight for r in binning.histogram(df, "v", 1.0).collect()} == {-1: 1, 0: 2, 1: 1}
    assert binning.dense(binning.histogram(df.limit(0), "v", 1.0)).count() == 0
    single = binning.histogram(df.where("v = 1.0"), "v", 1.0)
    assert binning.dense(single).count() == 1 and binning.dense(single, include_last=False).count() == 0


# --- association ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_nearest_in_time_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    left = [(i, float(t)) for i, t in enumerate(rng.integers(0, 60, 40) / 2)]
    right = [(i, float(t)) for i, t in enumerate(rng.integers(-10, 70, 30) / 2)]
    got = association.nearest(spark.createDataFrame(left, "lid long, t double"), spark.createDataFrame(right, "id long, t double"), 1.5).collect()
    want = {}
    for i, t in left:
        best = min(((abs(u - t), j) for j, u in right), default=None)
        want[i] = best[1] if best[0] <= 1.5 else None
    assert {r.lid: r.match.id if r.match else None for r in got} == want and len(got) == len(left)
    empty = association.nearest(spark.createDataFrame(left, "lid long, t double"), spark.createDataFrame([], "id long, t double"), 1.5)
    assert all(r.match is None for r in empty.collect()) and empty.count() == len(left)


# --- relational and collections ---------------------------------------------------------


def test_tables_and_selections(spark):
    spec = relational.Table("orrery_t", [relational.Column("a", "integer", required=True), relational.Column("b", "text")], ("a",))
    spec.create(spark, if_not_exists=True)
    try:
        spec.insert(spark, [1, "x"])
        with pytest.raises(ValueError):
            spec.insert(spark, [1])
        assert relational.table_exists(spark, "orrery_t") and spark.table("orrery_t").count() == 1
        assert {r.rule: r.violations for r in spec.violations(spark.table("orrery_t")).collect()} == {"required a": 0, "primary key a": 0}
    finally:
        spec.drop(spark)
    df = spark.createDataFrame([(2, None), (1, "b"), (1, "b")], "a int, b string")
    s_ = relational.Selection("t", distinct=True, order_by=[relational.OrderBy("b")])
    assert [tuple(r) for r in s_.over({"t": df}).collect()] == [(2, None), (1, "b")]
    with pytest.raises(ValueError):
        relational.Selection("t", joins=[relational.Join("t", how="full")]).over({"t": df})


def test_relational_plans_stay_in_the_jvm(spark):
    from orrery import plans, registry  # noqa: F401

    for name in ("sel_inner_join", "stats_running", "asof_nearest", "argmin_ties", "box_contains"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan, name


def test_collections(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, k long")
    assert [r.id for r in collections.every_nth(df, 6, ["id"]).orderBy("id").collect()] == [0, 6, 12, 18]
    assert sorted(r.ord for r in collections.with_ordinal(df, [F.desc("id")]).collect()) == list(range(20))
    new = spark.createDataFrame([(3, 99), (50, 1)], "id long, k long")
    merged = {r.id: r.k for r in collections.upsert(df, new, ["id"]).collect()}
    assert merged[3] == 99 and merged[50] == 1 and len(merged) == 21
    assert sorted(r.id for r in collections.shuffled(df, ["id"]).collect()) == list(range(20))
    text = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, line string")
    assert [r.line for r in collections.insert_line(text, 1, "x").orderBy("ord").collect()] == ["a", "x", "b"]
    assert [r.line for r in collections.replace_line(text, 0, "y").orderBy("ord").collect()] == ["y", "b"]


# --- scalars ----------------------------------------------------------------------------


def test_grey_of_a_half_is_rounded_to_even(spark):
    halves = [(r, g, b) for r in range(0, 256, 5) for g in range(0, 256, 3) for b in range(0, 256, 4) if (299 * r + 587 * g + 114 * b) % 1000 == 500]
    rows = spark.createDataFrame(halves, "r int, g int, b int").select("r", "g", "b", s.grey(F.struct(*[F.col(c).cast("short").alias(c) for c in "rgb"])).alias("y"))
    assert [tuple(x) for x in rows.collect() if x.y != round((299 * x.r + 587 * x.g + 114 * x.b) / 1000)] == [] and len(halves) > 100


def test_scalars(spark):
    r = one(
        spark, half=s.round_even(F.lit(2.5)), cut=s.truncate(F.lit(-1.7)), wrap=s.angle_difference_degrees(F.lit(1.0), F.lit(359.0)), time=s.format_milliseconds(F.lit(90_061_005)),
        short=s.format_milliseconds(F.lit(7)), hsv=s.rgb_to_hsv(s.color(F.lit(0), F.lit(0), F.lit(0))), back=s.hsv_to_rgb(s.rgb_to_hsv(s.color(F.lit(200), F.lit(50), F.lit(100)))),
        kept=s.approx_distinct(F.array(*map(F.lit, (1.0, 1.05, 2.0))), 0.1), bag=s.set_properties(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))), low=s.to_8bit(F.lit(-1.0), 0.0, 1.0), top=s.to_8bit(F.lit(1.0), 0.0, 1.0),
    )
    assert (r.half, r.cut, r.wrap, r.time, r.short) == (2.0, -1, 2.0, "1d/1h/1m/1s/5ms", "7ms")
    assert tuple(r.hsv) == (-1.0, 0.0, -1.0) and all(abs(a - b) <= 1 for a, b in zip(r.back, (200, 50, 100)))
    assert r.kept == [1.0, 2.0] and r.bag == {"a": 2} and (r.low, r.top) == (0, 255)


def test_rotations_come_back(spark):
    axis = v.vec(1.0, -2.0, 0.5)
    m = v.rotation_about(axis, F.lit(1.1))
    p = g.pose(m, v.vec(1.0, 2.0, 3.0))
    r = one(
        spark, rigid=v.is_rotation(m), same=v.approx_equal(v.mat_vec(v.transpose(m), v.mat_vec(m, v.vec(3.0, 1.0, 2.0))), v.vec(3.0, 1.0, 2.0)), quat=v.quaternion_to_matrix(v.matrix_to_quaternion(m)), m=m,
        vector=v.matrix_from_rodrigues(v.rodrigues_from_matrix(m)), half=v.rodrigues_from_matrix(v.rotation_x(F.lit(math.pi))), none=v.rodrigues_from_matrix(v.mat(1, 0, 0, 0, 1, 0, 0, 0, 1)), unit=g.pose_mul(p, g.pose_inverse(p)),
        look=g.pose_axis(g.look_at(v.vec(0, 0, 0), v.vec(0, 0, 5), v.vec(0, 1, 0)), "z"), frame=v.is_rotation(g.plane_frame(g.plane(v.vec(0, 0, 0), v.vec(0.0, 1.0, 1.0)))),
    )
    assert r.rigid and r.same and r.frame
    assert np.allclose(r.quat, r.m) and np.allclose(r.vector, r.m) and np.allclose(r.half, (math.pi, 0, 0)) and np.allclose(r.none, 0)
    assert np.allclose(r.unit, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]) and np.allclose(r.look, (0, 0, 1))


def test_rays_and_boxes(spark):
    b = g.box(v.vec(0, 0, 0), v.vec(1, 1, 1))
    inside = g.ray(v.vec(0.5, 0.5, 0.5), v.vec(0.0, 0.0, 2.0))
    r = one(
        spark, through=g.ray_box_hits(g.ray(v.vec(-1, 0.5, 0.5), v.vec(1, 0, 0)), b), inside=g.ray_box_hits(inside, b), parallel=g.ray_box_hits(g.ray(v.vec(-1, 2, 0.5), v.vec(1, 0, 0)), b),
        touch=g.boxes_intersect(b, g.box(v.vec(1, 0, 0), v.vec(2, 1, 1))), overlap=g.boxes_overlap(b, g.box(v.vec(1, 0, 0), v.vec(2, 1, 1))), flat=g.triangle_normal(g.triangle(v.vec(0, 0, 0), v.vec(1, 1, 1), v.vec(2, 2, 2))),
        cut=F.size(g.box_difference(b, g.box(v.vec(0.4, 0.4, 0.4), v.vec(0.6, 0.6, 0.6)))), gone=F.size(g.box_difference(b, g.box(v.vec(-1, -1, -1), v.vec(2, 2, 2)))),
        cross=g.rays_cross_2d(g.ray(v.vec(0, 0, 0), v.vec(1, 0, 0)), g.ray(v.vec(2, -1, 0), v.vec(0, 1, 0))), gap=g.rays_midpoint(g.ray(v.vec(0, 0, 0), v.vec(1, 0, 0)), g.ray(v.vec(2, 0, 4), v.vec(0, 1, 0))),
        plane=g.ray_plane(inside, g.plane(v.vec(0, 0, 0), v.vec(1, 0, 0))),
    )
    assert r.through == [1.0, 2.0] and r.inside == [0.5] and r.parallel == [] and r.touch and not r.overlap
    assert r.flat.x is None and r.cut == 6 and r.gone == 0 and np.allclose(r.cross, (2, 0, 0)) and math.isclose(r.gap.gap, 4) and r.plane is None


def segment(a, b, p):
    t = np.clip(np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300), 0, 1)
    return np.linalg.norm(p - a - t * (b - a))


def triangle_distance(t, p):
    n = np.cross(t[1] - t[0], t[2] - t[0])
    if np.linalg.norm(n) > 1e-12:
        n = n / np.linalg.norm(n)
        q = p - n * np.dot(n, p - t[0])
        if all(np.dot(np.cross(t[(i + 1) % 3] - t[i], q - t[i]), n) > 0 for i in range(3)):
            return abs(np.dot(n, p - t[0]))
    return min(segment(t[i], t[(i + 1) % 3], p) for i in range(3))


def test_spatial_joins_are_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = rng.random((60, 3))
    tris = rng.random((25, 1, 3)) + rng.normal(0, 0.15, (25, 3, 3))
    pf = cloud(spark, pts)
    struct_of = lambda x: tuple(map(float, x))
    kind = "struct<x:double,y:double,z:double>"
    tf = spark.createDataFrame([(i, tuple(struct_of(c) for c in t)) for i, t in enumerate(tris)], f"id long, tri struct<a:{kind},b:{kind},c:{kind}>")
    got = {r.point_id: r.distance for r in spatial.nearest_triangle(pf, tf, 0.3).collect()}
    want = {i: min(triangle_distance(t, p) for t in tris) for i, p in enumerate(pts)}
    assert got.keys() == {i for i, d in want.items() if d <= 0.3} and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)

    ways = rng.normal(size=(60, 3))
    rays = pf.join(spark.createDataFrame([(i, struct_of(w)) for i, w in enumerate(ways)], f"id long, way {kind}"), "id").select("id", g.ray(F.col("pos"), F.col("way")).alias("ray"))
    hits = {(r.ray_id, r.triangle_id) for r in spatial.ray_hits(rays, tf, first_only=False).collect()}
    brute = set()
    for i, (o, w) in enumerate(zip(pts, ways)):
        for j, t in enumerate(tris):
            m = np.stack([-w, t[1] - t[0], t[2] - t[0]], 1)
            d, a, b = np.linalg.solve(m, o - t[0])
            if d >= 0 and a > 0 and b > 0 and a + b < 1:
                brute.add((i, j))
    assert hits == brute and brute

    asked = cloud(spark, rng.random((30, 3)) * 3 - 1)
    near = {r.query_id: r.distance for r in spatial.nearest(asked, pf).collect()}
    assert all(math.isclose(near[r.id], min(np.linalg.norm(pts - np.array(tuple(r.pos)), axis=1)), rel_tol=1e-9) for r in asked.collect()) and len(near) == 30
    assert spatial.nearest(asked, pf.limit(0)).count() == 0
    ties = cloud(spark, [(0, 0, 0), (0, 0, 0), (2, 0, 0)])
    assert {r.query_id: r.point_id for r in spatial.nearest(cloud(spark, [(1, 0, 0), (0, 0, 0)]), ties).collect()} == {0: 0, 1: 0}


def test_triangles_meet_boxes(spark):
    rng = np.random.default_rng(2)
    tris = rng.random((40, 3, 3)) * 2 - 0.5
    kind = "struct<x:double,y:double,z:double>"
    tf = spark.createDataFrame([(i, tuple(tuple(map(float, c)) for c in t)) for i, t in enumerate(tris)], f"id long, tri struct<a:{kind},b:{kind},c:{kind}>")
    got = {r.id for r in tf.where(g.triangle_hits_box(F.col("tri"), g.box(v.vec(0, 0, 0), v.vec(1, 1, 1)))).collect()}
    u = rng.dirichlet((1, 1, 1), 20_000)
    sampled = {i for i, t in enumerate(tris) if (((u @ t) >= 0) & ((u @ t) <= 1)).all(axis=1).any()}
    assert sampled <= got and len(got - sampled) <= 2


def test_clipping_keeps_volume(spark):
    box = lambda i, a, b: (i, (tuple(map(float, a)), tuple(map(float, b))))
    kind = "id long, box struct<min:struct<x:double,y:double,z:double>,max:struct<x:double,y:double,z:double>>"
    whole = spark.createDataFrame([box(0, (0, 0, 0), (4, 4, 4)), box(1, (9, 9, 9), (10, 10, 10))], kind)
    cutters = spark.createDataFrame([box(0, (1, 1, 1), (2, 2, 2)), box(1, (1, 1, 1), (3, 3, 3))], kind)
    left = spatial.clip_boxes(whole, cutters).groupBy("id").agg(F.sum(g.box_volume(F.col("box"))).alias("v")).collect()
    assert {r.id: r.v for r in left} == {0: 64 - 8, 1: 1}


def test_voxel_faces(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1), (0.5, 0, 0)])
    found = voxel.voxelize(p, 1.0, (0.0, 0.0, 0.0)).groupBy("id").count()
    assert {r.id: r["count"] for r in found.collect()} == {0: 1, 1: 1, 2: 2}
    assert voxel.occupancy(p.limit(0), 1.0).count() == 0
    counted = voxel.apply(p, 1.0, lambda f: f[["vx"]].head(1).assign(n=len(f)), "vx long, n long", (0.0, 0.0, 0.0))
    assert counted.agg(F.sum("n")).first()[0] == 4


# --- grids and images -------------------------------------------------------------------


def as_grid(spark, a):
    return spark.createDataFrame([(int(x), int(y), int(z), float(a[x, y, z])) for x, y, z in np.ndindex(a.shape)], "x int, y int, z int, v double")


def test_filters_are_those_of_arrays(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, (6, 5, 4)).astype(float)
    k = grid.gaussian_kernel(3, 0.9)
    want = a
    for axis in range(3):
        want = np.apply_along_axis(lambda r: np.convolve(r, k, "same"), axis, want)
    got = np.zeros_like(a)
    for r in grid.gaussian(as_grid(spark, a), 3, 0.9).collect():
        got[r.x, r.y, r.z] = r.v
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        grid.gaussian_kernel(4, 1.0)
    flat = as_grid(spark, np.ones((1, 3, 2)))
    assert grid.gaussian(flat, 3, 0.9).count() == 6 and grid.sobel(flat).agg(F.max("gx")).first()[0] == 0
    assert grid.normalize(flat).agg(F.max("v")).first()[0] == 0


def test_hysteresis_follows_chains(spark):
    a = np.zeros((40, 1, 1))
    a[:30] = 5
    a[0] = 9
    a[35] = 5
    assert {r.x for r in grid.hysteresis(as_grid(spark, a), 5, 9).collect()} == set(range(30))
    assert grid.hysteresis(as_grid(spark, a), 50, 90).count() == 0


def test_march_stops_at_first_and_at_closed_diagonals(spark):
    occupied = spark.createDataFrame([(5, 0, 0), (7, 0, 0), (3, 3, 0), (3, 2, 0), (2, 3, 0), (0, 9, 0)], "x int, y int, z int")
    rays = spark.createDataFrame([(0, 0, 0, 1, 0, 0), (0, 0, 0, 1, 1, 0), (0, 9, 0, 1, 0, 0)], "x int, y int, z int, dx int, dy int, dz int")
    assert {tuple(r) for r in grid.march(rays, occupied).collect()} == {(5, 0, 0)}
    loose = occupied.where("not (x = 2 and y = 3)")
    assert {tuple(r) for r in grid.march(rays, loose).collect()} == {(5, 0, 0), (3, 3, 0)}


def test_images(spark):
    dot = spark.createDataFrame([(2, 2)], "r int, c int")
    grown = raster.dilate(dot, raster.disc(1), 5, 5)
    assert grown.count() == 5 and [tuple(r) for r in raster.erode(grown, raster.disc(1), 5, 5).collect()] == [(2, 2)]
    assert raster.dilate(spark.createDataFrame([(0, 0)], "r int, c int"), raster.disc(1), 5, 5).count() == 0
    assert (0, 0) not in raster.ring(2) and len(raster.square(1)) == 9
    c = raster.confusion(grown, dot, 5, 5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 4, 0, 20)
    h = spark.createDataFrame([(b, 10.0 if b in (0, 1, 8, 9) else 0.0) for b in range(10)], "bin long, weight double")
    assert 1 <= raster.otsu(h).first().threshold <= 7
    assert raster.upscale(spark.createDataFrame([(0, 0, 7)], "r int, c int, v int"), 3).count() == 9


def test_meshes(spark):
    vertices, faces = mesh.box_mesh(spark, (0, 0, 0), (1, 2, 3))
    m = mesh.measures(mesh.triangles(vertices, faces)).collect()
    assert math.isclose(sum(r.area for r in m), 22.0)
    assert all(np.dot(tuple(r.normal), np.array(tuple(r.centroid)) - (0.5, 1, 1.5)) > 0 for r in m)
    two = lambda df: df.withColumn("mesh_id", F.lit(0)).unionByName(df.withColumn("mesh_id", F.lit(1)))
    mv, mf = mesh.merge(two(vertices), two(faces))
    assert mv.agg(F.max("vertex_id")).first()[0] == 15 and mf.agg(F.max("v1")).first()[0] > 7
    assert mesh.unwrap(faces, vertices).count() == 36 and mesh.sphere(spark, (0, 0, 0), 1.0, 4, 6).count() == 30
    assert mesh.checkerboard(spark, 4, 3, 0.1).count() == 12 and mesh.plane_grid(spark, 1.0, 1.0, 0.5).count() == 9


# --- files ------------------------------------------------------------------------------


def test_point_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2,3,9\nx,2,3,9\n1,2\n\n4,,5,6,7\n")
    found = points.read_points(spark, str(tmp_path / "p.csv"), points.PointLayout(doubles={"w": 3})).collect()
    assert [(tuple(r.pos), r.w) for r in found] == [((1, 2, 3), 9), ((4, 5, 6), 7)]
    with pytest.raises(ValueError):
        points.PointLayout(doubles={"w": 2})


def test_pose_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("5 1 2 3 1 0 0 0 1 0 0 0 1\n9\n7 1 2\n")
    found = {r.ts: r.pose for r in poses.read_poses(spark, str(tmp_path / "t.txt")).collect()}
    assert found == {5: [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3], 9: None}
    df = spark.createDataFrame([(1, found[5]), (2, None)], "ts long, pose array<double>")
    poses.write_poses(df, str(tmp_path / "o"), "matrix")
    assert {r.ts: r.pose for r in poses.read_poses(spark, str(tmp_path / "o")).collect()} == {1: found[5], 2: None}
    (tmp_path / "m.txt").write_text("1 0 0 4\n0 1 0 5\n0 0 1 6\n0 0 0 1\n")
    assert poses.read_pose_matrix(spark, str(tmp_path / "m.txt")).first().pose == [1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6]
    (tmp_path / "i.txt").write_text("# c\n1 1 0 0 0 1 2 3 7 a.jpg\n0 0 1\n2 1 0 0 0 0 0 1 7 b.jpg\n\n")
    (tmp_path / "c.txt").write_text("# c\n7 PINHOLE 640 480 500 501 320 240\n")
    both = poses.trajectory(poses.read_images(spark, str(tmp_path / "i.txt")), poses.read_cameras(spark, str(tmp_path / "c.txt"))).collect()
    assert {r.image_id: (r.pose[3], r.intrinsics.fy) for r in both} == {1: (-1, 501), 2: (0, 501)}


def test_ply_encodings(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty double y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    rows = [(0.5, 1.0, 2.0, 200), (1.5, 1.25, -2.0, 7), (3.0, 0.0, 0.0, 0)]
    for name, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        raw = head.format(name).encode() + b"".join(struct.pack(f"{order}fdfB", *r) for r in rows) + struct.pack(f"{order}Biii", 3, 0, 1, 2)
        (tmp_path / f"{name}.ply").write_bytes(raw)
    text = head.format("ascii") + "".join(" ".join(map(str, r)) + "\n" for r in rows) + "3 0 1 2\n"
    (tmp_path / "ascii.ply").write_text(text)
    found = ply.read_ply(spark, str(tmp_path))
    assert found.count() == 9 and {(r.x, r.y, r.z, r.red) for r in found.collect()} == set(rows)
    assert {(r.v1, r.v2, r.v3) for r in ply.read_ply(spark, str(tmp_path), "face").collect()} == {(0, 1, 2)}
    assert ply.read_ply(spark, str(tmp_path), columns=["y"]).columns == ["file", "vertex_id", "y"]
    assert ply.points_of(ply.read_ply(spark, str(tmp_path))).columns == ["vertex_id", "pos", "red"]


def test_grid_files_and_listings(spark, tmp_path):
    for i in range(2):
        raw = io.BytesIO()
        np.save(raw, np.arange(12.0).reshape(2, 3, 2) + 100 * i)
        (tmp_path / f"split_{i}.npy").write_bytes(raw.getvalue())
    joined = grid_rows = images.join_splits(images.read_grids(spark, str(tmp_path / "*.npy")))
    assert joined.count() == 24 and {r.x for r in grid_rows.collect()} == {0, 1, 2, 3} and joined.where("x = 2 and y = 0 and z = 1").first().v == 101
    for n in ("1.5.png", "note.txt", "abc.png"):
        (tmp_path / n).write_text("x")
    assert {r.t for r in images.list_images(spark, str(tmp_path)).collect()} == {1.5, None}


def test_lines_and_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    assert [r.values for r in lines.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("row").collect()] == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "r.txt").write_text("1 2 3\n4 5\n")
    with pytest.raises(Exception, match="rows differ"):
        lines.read_matrix(spark, str(tmp_path / "r.txt")).collect()


def test_whole_spatial_queries_are_brute_force(spark):
    from orrery.plans import spatial as plans

    d = "/root/testdata/sf0.001"
    b = {r.id: (tuple(r.box.min), tuple(r.box.max)) for r in plans.boxes(spark, d).collect()}
    meets = lambda p, q, less: all(less(x, w) and less(y, z) for x, z, y, w in zip(p[0], p[1], q[0], q[1]))
    pairs = lambda df: sorted((r.a_id, r.b_id) for r in df.collect())
    assert pairs(plans.box_overlap_whole(spark, d)) == sorted((i, j) for i in b for j in b if i < j and meets(b[i], b[j], lambda x, y: x < y))
    assert pairs(plans.box_intersect_whole(spark, d)) == sorted((i, j) for i in b for j in b if meets(b[i], b[j], lambda x, y: x <= y))
    cells = lambda p: set(np.ndindex(*[int(2 * (y - x)) for x, y in zip(*p)]))
    placed = lambda p: {tuple(int(2 * x) + k for x, k in zip(p[0], c)) for c in cells(p)}
    cut = set().union(*[placed((p[1], tuple(x + 1 for x in p[1]))) for p in b.values()])
    want = {i: len(placed(p) - cut) / 8 for i, p in b.items() if placed(p) - cut}
    assert {r.id: r.volume for r in plans.boxes_clipped_whole(spark, d).collect()} == want
    points = {r.id: tuple(r.pos) for r in plans.points(spark, d).collect()}
    got = {r.id: r.distance for r in plans.nn_unbounded_whole(spark, d).collect()}
    ids, at = list(points), np.array(list(points.values()), dtype=float)
    for i in ids:
        x, y, z = points[i]
        assert abs(got[i] - np.sqrt(((at - [2 * x, y, z]) ** 2).sum(axis=1)).min()) < 1e-7
    assert len(got) == len(ids)


@pytest.mark.parametrize("name", ["box_any", "box_contains", "box_overlap", "box_overlap_whole", "box_intersect", "box_intersect_whole", "boxes_clipped", "boxes_clipped_whole", "boxes_disjoint"])
def test_cells_of_boxes_are_not_broadcast(spark, name):
    """A file of some MB has more rows and cells than a driver can send round."""
    from orrery import plans, registry  # noqa: F401

    assert "Broadcast" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_equal_boxes_are_counted_each(spark):
    cube = lambda x: ((x, 0.0, 0.0), (x + 1.0, 1.0, 1.0))
    boxes = spark.createDataFrame([(i, cube(float(i % 3))) for i in range(30)] + [(99, None)], "id long, box struct<min:struct<x:double,y:double,z:double>,max:struct<x:double,y:double,z:double>>")
    points = cloud(spark, [(0.5, 0.5, 0.5)] * 3 + [(1.0, 0.5, 0.5)])
    assert {r.box_id: r.n for r in spatial.count_points(points, boxes).collect()} == {i: (4, 1)[i % 3] for i in range(30) if i % 3 < 2}
    assert sorted(r.id for r in spatial.any_in_box(boxes, points).collect()) == [i for i in range(30) if i % 3 < 2]


def test_all_rays_meet_a_level_triangle_at_one_distance_once(spark):
    rng = np.random.default_rng(8)
    rays = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((3000, 2)) * 0.05)], "id long, x double, y double").select("id", g.ray(v.vec(F.col("x") - 1, F.col("y") - 0.5, -2.0), v.vec(0.5, 0.25, 1.0)).alias("ray"))
    tris = spark.range(3).select("id", g.triangle(*[v.vec(x, y, 0.123456789 * F.col("id")) for x, y in ((0.0, 0.0), (0.07, 0.01), (0.01, 0.08))]).alias("tri"))
    got = spatial.ray_hits(rays, tris, size=0.02, first_only=False)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()  # hits aren't shuffled
    rows = got.collect()
    assert len(rows) == len({(r.ray_id, r.triangle_id) for r in rows}) > 1000
    for i in {r.triangle_id for r in rows}:
        found = {r.distance for r in rows if r.triangle_id == i}
        assert len(found) == 1 and math.isclose(*found, (0.123456789 * i + 2) * math.sqrt(1.3125), rel_tol=1e-15)


def test_nearest_triangles_meet_few_of_those_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(9)
    corners = rng.random((500, 1, 3)) + np.array([(0, 0, 0), (0.3, 0.05, 0), (0.05, 0.3, 0)])
    kind = "struct<x:double,y:double,z:double>"
    tf = spark.createDataFrame([(i, tuple(tuple(map(float, c)) for c in t)) for i, t in enumerate(corners)], f"id long, tri struct<a:{kind},b:{kind},c:{kind}>")
    tried, whole = [], spatial.points_in_boxes
    monkeypatch.setattr(spatial, "points_in_boxes", lambda *a, **k: (tried.append((found := whole(*a, **k)).count()), found)[1])
    pts = rng.random((100, 3))
    got = {r.point_id: r.distance for r in spatial.nearest_triangle(cloud(spark, pts), tf, 2.0).collect()}
    assert len(got) == 100 and all(math.isclose(got[i], min(triangle_distance(t, p) for t in corners), rel_tol=1e-9) for i, p in enumerate(pts))
    assert sum(tried) < 50 * 100  # not all 50000
