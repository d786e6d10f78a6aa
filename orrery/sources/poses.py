"""Trajectories as text: several line formats, and structure-from-motion exports.

A pose is ``array<double>(12)``, the first three rows of its 4x4 matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from .lines import read_lines, tokens

#: Tokens of a line, the timestamp included, by format.
FORMATS = {"matrix": 13, "quaternion": 8, "euler": 7, "counter": 16}


def _doubles(parts: Column, first: int, n: int) -> list[Column]:
    return [F.get(parts, F.lit(first + i)).cast("double") for i in range(n)]


def _pose(kind: str, t: Column) -> Column:
    if kind == "matrix":  # t x y z, then the rotation by columns
        p, m = _doubles(t, 1, 3), _doubles(t, 4, 9)
        return g.pose(v.transpose(v.mat(*m)), v.vec(*p))
    if kind == "quaternion":
        p, q = _doubles(t, 1, 3), _doubles(t, 4, 4)
        return g.pose(v.quaternion_to_matrix(F.struct(*[c.alias(n) for c, n in zip(q, ("x", "y", "z", "w"))])), v.vec(*p))
    if kind == "euler":  # in degrees
        p, e = _doubles(t, 1, 3), _doubles(t, 4, 3)
        return g.pose(v.matrix_from_euler(v.vec(*[F.radians(x) for x in e])), v.vec(*p))
    m = _doubles(t, 0, 16)  # a whole matrix by columns
    return F.array(*[m[4 * c + r] for r in range(3) for c in range(4)])


def read_poses(spark: SparkSession, path: str, kind: str = "matrix") -> DataFrame:
    """``(ts, pose)``; lines with another number of tokens are left out.

    In format ``matrix`` a line of the timestamp alone is a missing pose (null); in
    ``counter`` the timestamp is the number of the line among those accepted.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown pose format {kind}")
    lines = read_lines(spark, path).withColumn("t", tokens(F.col("line")))
    t, n = F.col("t"), F.size("t")
    if kind == "counter":
        from ..operators.collections import with_ordinal

        kept = with_ordinal(lines.where(n == FORMATS[kind]), ["file", "ord"], "ts")
        return kept.select("ts", _pose(kind, t).alias("pose"))
    accepted = lines.where((n == FORMATS[kind]) | ((n == 1) if kind == "matrix" else F.lit(False)))
    return accepted.select(F.get(t, F.lit(0)).cast("long").alias("ts"), F.when(n > 1, _pose(kind, t)).alias("pose"))


def pose_line(kind: str, ts: Column, p: Column) -> Column:
    """The inverse of reading, for the formats that have one."""
    r, at = g.pose_rotation(p), g.pose_position(p)
    values = [at["x"], at["y"], at["z"]]
    if kind == "matrix":
        values += [v.at(r, i, c) for c in range(3) for i in range(3)]
    elif kind == "quaternion":
        q = v.matrix_to_quaternion(r)
        values += [q[k] for k in ("x", "y", "z", "w")]
    elif kind == "counter":
        return F.concat_ws(" ", *[F.get(p, F.lit(4 * i + c)).cast("string") if i < 3 else F.lit("1.0" if c == 3 else "0.0") for c in range(4) for i in range(4)])
    else:
        raise ValueError(f"format {kind} can't be written: its angles don't give the matrix back")
    full = F.concat_ws(" ", ts.cast("string"), *[x.cast("string") for x in values])
    return F.when(p.isNull(), ts.cast("string")).otherwise(full) if kind == "matrix" else full


def write_poses(poses: DataFrame, path: str, kind: str = "matrix", mode: str = "error") -> None:
    from .lines import write_lines

    write_lines(poses.select("ts", pose_line(kind, F.col("ts"), F.col("pose")).alias("line")), path, ["ts"], single=True, mode=mode)


def read_pose_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pose)``: a 4x4 matrix for each file; anything but 16 numbers with 0 0 0 1 last raises an error."""
    t = tokens(F.col("value"))
    m = F.transform(t, lambda x: x.cast("double"))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), m.alias("m"))
    ok = (F.size("m") == 16) & (F.slice("m", 13, 4) == F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    return rows.select("file", F.when(ok, F.slice("m", 1, 12)).otherwise(F.raise_error(F.lit("not a pose matrix")).cast("array<double>")).alias("pose"))


# --- structure from motion --------------------------------------------------------------


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, camera_id, name, pose)``: camera-to-world poses from an image list.

    Lines that start with # don't count; of the others every second one, from the first on,
    is an image: id, quaternion (w first), translation, camera, name.
    """
    from ..operators.collections import with_ordinal

    lines = read_lines(spark, path).where(~F.col("line").startswith("#"))
    t = F.col("t")
    rows = with_ordinal(lines, ["file", "ord"], "_n").where("_n % 2 = 0").withColumn("t", tokens(F.col("line"))).where(F.size("t") >= 10)
    w, x, y, z = _doubles(t, 1, 4)
    q = F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))
    world_to_camera = g.pose(v.quaternion_to_matrix(q), v.vec(*_doubles(t, 5, 3)))
    return rows.select(
        F.get(t, F.lit(0)).cast("int").alias("image_id"), F.get(t, F.lit(8)).cast("int").alias("camera_id"), F.get(t, F.lit(9)).alias("name"), world_to_camera.alias("_p")
    ).select("image_id", "camera_id", "name", g.pose_inverse(F.col("_p")).alias("pose"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``(camera_id, model, width, height, intrinsics, distortion)``; other models than the three known raise an error."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(tokens(F.col("value")).alias("t"))
    t = F.col("t")
    p = _doubles(t, 4, 8)
    make = lambda fx, fy, cx, cy: F.struct(fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy"))
    model = F.get(t, F.lit(1))
    unknown = lambda kind: F.raise_error(F.concat(F.lit("unknown camera model "), model)).cast(kind)
    intrinsics = F.when(model == "SIMPLE_RADIAL", make(p[0], p[0], p[1], p[2])).when(model.isin("PINHOLE", "OPENCV"), make(*p[:4]))
    distortion = F.when(model == "SIMPLE_RADIAL", F.array(p[3])).when(model == "PINHOLE", F.array().cast("array<double>")).when(model == "OPENCV", F.array(*p[4:8]))
    return rows.select(
        F.get(t, F.lit(0)).cast("int").alias("camera_id"), model.alias("model"), F.get(t, F.lit(2)).cast("int").alias("width"), F.get(t, F.lit(3)).cast("int").alias("height"),
        intrinsics.otherwise(unknown("struct<fx:double,fy:double,cx:double,cy:double>")).alias("intrinsics"), distortion.otherwise(unknown("array<double>")).alias("distortion"),
    )


def read_sfm_points(spark: SparkSession, path: str) -> DataFrame:
    """``(id, pos, color)``."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(tokens(F.col("value")).alias("t")).where(F.size("t") >= 7)
    t = F.col("t")
    color = F.struct(*[F.get(t, F.lit(4 + i)).cast("short").alias(c) for i, c in enumerate("rgb")])
    return rows.select(F.get(t, F.lit(0)).cast("long").alias("id"), v.vec(*_doubles(t, 1, 3)).alias("pos"), color.alias("color"))


def trajectory(images: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """Images with their camera's columns; an image without one raises an error."""
    if cameras is None:
        return images
    joined = images.join(cameras, "camera_id", "left")
    known = F.when(F.col("model").isNull(), F.raise_error(F.lit("an image has no camera")).cast("string")).otherwise(F.col("model"))
    return joined.withColumn("model", known)


def renumber_images(images: DataFrame) -> DataFrame:
    """``(image_id, new_id)``: dense numbers from 1 in order of ids."""
    from ..operators.collections import with_ordinal

    return with_ordinal(images.select("image_id").distinct(), ["image_id"], "_n").select("image_id", (F.col("_n") + 1).alias("new_id"))


def move_poses(images: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """Every camera shifted."""
    p = F.col("pose")
    return images.withColumn("pose", g.pose(g.pose_rotation(p), v.add(g.pose_position(p), v.vec(*offset))))


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, pose, height, width, intrinsics)`` from a training-transform JSON file."""
    schema = "h int, w int, fl_x double, fl_y double, cx double, cy double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("*", F.explode("frames").alias("f"))
    pose = F.flatten(F.slice("f.transform_matrix", 1, 3))
    intrinsics = F.struct(F.col("fl_x").alias("fx"), F.col("fl_y").alias("fy"), "cx", "cy")
    return rows.select("f.file_path", pose.alias("pose"), F.col("h").alias("height"), F.col("w").alias("width"), intrinsics.alias("intrinsics"))


def read_registration(spark: SparkSession, path: str) -> DataFrame:
    """``(step, pose)`` from a registration chain; a step marked ``invert`` is inverted."""
    schema = "transforms array<struct<invert:boolean,transform:array<array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("transforms").alias("step", "t"))
    pose = F.flatten(F.slice("t.transform", 1, 3))
    return rows.select("step", F.when(F.coalesce(F.col("t.invert"), F.lit(False)), g.pose_inverse(pose)).otherwise(pose).alias("pose"))


def read_crop(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(center, size, orientation)`` for each crop file."""
    rows = spark.read.schema("center array<double>, size array<double>, orientation array<array<double>>").json(path, multiLine=True)
    xyz = lambda c: v.vec(*[F.get(F.col(c), F.lit(i)) for i in range(3)]).alias(c)
    return rows.select(xyz("center"), xyz("size"), F.flatten("orientation").alias("orientation"))
