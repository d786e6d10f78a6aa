"""Structure-from-motion tables rewritten, and made from bundles."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import vectors as v
from orrery.sources import bundle, poses

IMAGES = """# a list
30 1 0 0 0 1.5 2 3 1 b.png
1 2 3  4
7 1 0 0 0 0 0 0.25 2 a b.png

# between
12 1 0 0 0 -1 0 1e3 1 c.png
"""
POINTS = """# points
5 1 2 3 10 20 30 0.5 7 0 30 2 7 1
6 1 2 3 10 20 30 0.5

9 1 2 3 10 20 30 0.5 12 4
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "images.txt").write_text(IMAGES)
    (tmp_path / "points.txt").write_text(POINTS)
    return tmp_path


def text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


@pytest.mark.parametrize("single", [True, False])
def test_new_ids_in_lists_and_tracks(spark, files, single):
    bundle.renumber_sfm(spark, f"{files}/images.txt", f"{files}/points.txt", f"{files}/out", single)
    assert text(files / "out/images") == IMAGES.replace("30 1 0", "1 1 0").replace("7 1 0", "2 1 0").replace("12 1 0", "3 1 0")
    assert text(files / "out/points3D") == POINTS.replace("7 0 30 2 7 1", "2 0 1 2 2 1").replace("12 4", "3 4")
    got = bundle.read_tracks(spark, f"{files}/out/points3D").orderBy("id", "at").collect()
    assert [tuple(r) for r in got] == [(5, 0, 2, 0), (5, 1, 1, 2), (5, 2, 2, 1), (9, 0, 3, 4)]
    assert [r.image_id for r in poses.read_images(spark, f"{files}/out/images").orderBy("image_id").collect()] == [1, 2, 3]


@pytest.mark.parametrize("name, old, new", [("points.txt", "12 4", "13 4"), ("images.txt", "12 1", "7 1"), ("images.txt", "12 1", "x 1"), ("points.txt", "12 4", "12")])
def test_unknown_and_repeated_ids_raise(spark, files, name, old, new):
    (files / name).write_text((files / name).read_text().replace(old, new))
    with pytest.raises(Exception, match="isn't listed|one id|no number|half a pair"):
        bundle.renumber_sfm(spark, f"{files}/images.txt", f"{files}/points.txt", f"{files}/out")


def test_translations_are_shifted(spark, files):
    bundle.shift_translations(spark, f"{files}/images.txt", f"{files}/moved", (1.0, -2.0, 0.5))
    lines = text(files / "moved").splitlines()
    assert lines[0] == "# a list" and lines[1] == "30 1 0 0 0 2.5 0.0 3.5 1 b.png" and lines[2] == "1 2 3  4" and lines[4] == ""
    assert lines[3] == "7 1 0 0 0 1.0 -2.0 0.75 2 a b.png"


def bundle_file(spark, path, n=3):
    cameras = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") + 500.0).alias("focal"), F.lit(0.1).alias("k1"), F.lit(0.0).alias("k2"), g.pose(v.rotation_z(F.col("id") / 10), v.vec("id", 1.0, 2.0)).alias("pose"))
    dots = spark.range(5).select(F.col("id").alias("idx"), v.vec("id", 0.0, 1.0).alias("pos"), F.struct(*[F.lit(9).cast("short").alias(k) for k in "rgb"]).alias("color"))
    bundle.write_bundle(cameras, dots, path)


@pytest.mark.parametrize("descending", [True, False])
def test_bundles_become_tables(spark, tmp_path, descending):
    bundle_file(spark, f"{tmp_path}/b")
    names = spark.createDataFrame([("c.png",), ("a.png",), ("b.png",)], "name string")
    bundle.bundle_to_sfm(spark, f"{tmp_path}/b", names, f"{tmp_path}/s", 640, 480, descending)
    got = poses.trajectory(poses.read_images(spark, f"{tmp_path}/s/images"), poses.read_cameras(spark, f"{tmp_path}/s/cameras")).orderBy("image_id").collect()
    assert [r.name for r in got] == sorted(["a.png", "b.png", "c.png"], reverse=descending)
    assert [(r.image_id, r.camera_id, r.intrinsics.fx, r.intrinsics.cx, r.height) for r in got] == [(i + 1, i + 1, 500.0 + i, 320.0, 480) for i in range(3)]
    assert all(abs(r.pose[3] - i) < 1e-9 and abs(r.pose[11] - 2) < 1e-9 for i, r in enumerate(got))
    assert poses.read_sfm_points(spark, f"{tmp_path}/s/points3D").count() == 5


@pytest.mark.parametrize("names", [["a"], ["a", "b", "c", "d"], []])
def test_as_many_images_as_poses(spark, tmp_path, names):
    bundle_file(spark, f"{tmp_path}/b")
    with pytest.raises(Exception, match="differ in number"):
        bundle.bundle_to_sfm(spark, f"{tmp_path}/b", spark.createDataFrame([(n,) for n in names], "name string"), f"{tmp_path}/s", 640, 480)
