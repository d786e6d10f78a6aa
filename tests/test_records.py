"""Files of records of one size: written in place, read by ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import images, ply


@pytest.fixture
def model(spark):
    vertices = spark.range(1000).select((F.col("id") * 7).alias("vertex_id"), F.col("id").cast("double").alias("x"), (F.col("id") / 4).alias("y"), F.lit(1.5).alias("z"), (F.col("id") % 250).cast("short").alias("red"), F.col("id").cast("int").alias("mark"))
    faces = spark.range(998).select(F.col("id").alias("face_id"), *[((F.col("id") + k) * 7).alias(f"v{k + 1}") for k in range(3)], (F.col("id") * 0.5).cast("float").alias("area"))
    return vertices.repartition(7), faces.repartition(5)


@pytest.mark.parametrize("size", [1, 997, 1 << 20])
def test_binary_ply_comes_back(spark, model, tmp_path, size):
    vertices, faces = model
    ply.write_ply_binary(vertices, f"{tmp_path}/a.ply", faces)
    back = ply.read_ply(spark, f"{tmp_path}/a.ply", range_bytes=size)
    if size > 1:  # one record a range is for the few faces below
        assert back.rdd.getNumPartitions() == -(-1000 // max(1, size // 29))
        got = back.orderBy("vertex_id").collect()
        assert [(r.vertex_id, r.x, r.y, r.z, r.red, r.mark) for r in got] == [(i, float(i), i / 4, 1.5, i % 250, i) for i in range(1000)]
    f = ply.read_ply(spark, f"{tmp_path}/a.ply", "face", range_bytes=max(size, 500)).orderBy("face_id").collect()
    assert [(r.face_id, r.v1, r.v2, r.v3, r.area) for r in f] == [(i, i, i + 1, i + 2, i * 0.5) for i in range(998)]
    raw = open(f"{tmp_path}/a.ply", "rb").read()
    header = ply.parse_header(raw)
    assert len(raw) == header.length + 1000 * 29 + 998 * 17
    assert [p.name for p in tmp_path.iterdir()] == ["a.ply"]


def test_binary_ply_refuses(spark, model, tmp_path):
    vertices, faces = model
    ply.write_ply_binary(vertices, f"{tmp_path}/a.ply", coordinates_as_float=True)
    assert dict(ply.read_ply(spark, f"{tmp_path}/a.ply").dtypes)["x"] == "float"
    with pytest.raises(FileExistsError):
        ply.write_ply_binary(vertices, f"{tmp_path}/a.ply")
    with pytest.raises(Exception, match="vertex that is missing"):
        ply.write_ply_binary(vertices, f"{tmp_path}/b.ply", faces.withColumn("v2", F.col("v2") + 1))
    with pytest.raises(ValueError, match="share"):
        ply.write_ply_binary(vertices, "s3://somewhere/b.ply")
    ply.write_ply_binary(vertices.where("false"), f"{tmp_path}/a.ply", mode="overwrite")
    assert ply.read_ply(spark, f"{tmp_path}/a.ply").count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["a.ply"]


def test_text_and_both_byte_orders_side_by_side(spark, tmp_path):
    head = "ply\nformat {} 1.0\ncomment a\nelement vertex 3\nproperty float x\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "t.ply").write_text(head.format("ascii") + "1.5 7\n2.5 8\n3.5 9\n3 0 1 2\n")
    for name, order in (("little", "<"), ("big", ">")):
        v = np.array([(1.5, 7), (2.5, 8), (3.5, 9)], [("x", f"{order}f4"), ("r", "u1")])
        f = np.array([(3, (0, 1, 2))], [("n", "u1"), ("i", f"{order}i4", (3,))])
        (tmp_path / f"{name}.ply").write_bytes(head.format(f"binary_{name}_endian").encode() + v.tobytes() + f.tobytes())
    got = ply.read_ply(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.vertex_id, r.x, r.red) for r in got) == sorted((n, i, i + 1.5, i + 7) for n in ("t.ply", "little.ply", "big.ply") for i in range(3))
    assert [(r.v1, r.v2, r.v3) for r in ply.read_ply(spark, str(tmp_path), "face").collect()] == [(0, 1, 2)] * 3


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("kind", ["<f4", ">i2", "|b1"])
def test_grids_by_ranges(spark, tmp_path, backwards, kind):
    grid = (np.arange(4 * 3 * 5) % 7).reshape(4, 3, 5).astype(kind)
    np.save(tmp_path / "g.npy", np.asfortranarray(grid) if backwards else grid)
    found = images.read_grids(spark, f"{tmp_path}/g.npy", range_bytes=13)
    assert found.rdd.getNumPartitions() > 3
    assert {(r.x, r.y, r.z): r.v for r in found.collect()} == {(x, y, z): float(grid[x, y, z]) for x in range(4) for y in range(3) for z in range(5)}


def test_grids_of_other_shapes_are_refused(spark, tmp_path):
    np.save(tmp_path / "g.npy", np.zeros((2, 2)))
    with pytest.raises(ValueError, match="three axes"):
        images.read_grids(spark, f"{tmp_path}/g.npy")
