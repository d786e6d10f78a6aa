"""Bundle files (cameras, points and tracks in one text), and structure-from-motion text tables.

A bundle's lines have their meaning by their number: two of header, five for each camera, three for
each point. So a file is read as numbered lines by many tasks and put together by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators.collections import with_ordinal
from .lines import read_lines, tokens, write_lines

HEAD, CAMERA, POINT = 2, 5, 3


def _numbers(line: Column) -> Column:
    return F.transform(tokens(line), lambda t: t.cast("double"))


def _parted(spark: SparkSession, path: str) -> DataFrame:
    """``(file, part, idx, row, line)``: part 0 are cameras, 1 points; row counts the lines of one."""
    lines = read_lines(spark, path)
    heads = lines.where("ord = 1").select(F.col("file").alias("of"), F.get(tokens(F.col("line")), F.lit(0)).try_cast("long").alias("cameras"), F.get(tokens(F.col("line")), F.lit(1)).try_cast("long").alias("points"))  # a row for each file
    at = F.col("ord") - HEAD
    later = at - CAMERA * F.col("cameras")
    first = later < 0
    rows = lines.where(F.col("ord") >= HEAD).join(heads, F.col("file") == F.col("of")).where(later < POINT * F.col("points"))
    idx, row = F.floor(F.when(first, at / CAMERA).otherwise(later / POINT)), F.when(first, at % CAMERA).otherwise(later % POINT)
    return rows.select("file", F.when(first, 0).otherwise(1).alias("part"), idx.alias("idx"), row.cast("int").alias("row"), "line")


def read_bundle_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``(file, idx, focal, k1, k2, pose)``: camera-to-world poses."""
    rows = _parted(spark, path).where("part = 0").groupBy("file", "idx").agg(*[F.max(F.when(F.col("row") == k, F.col("line"))).alias(f"l{k}") for k in range(CAMERA)])
    n = [_numbers(F.col(f"l{k}")) for k in range(CAMERA)]
    at = lambda k, i: F.get(n[k], F.lit(i))
    rotation = v.mat(*[at(k, i) for k in (1, 2, 3) for i in range(3)])
    inner = g.pose(rotation, v.vec(at(4, 0), at(4, 1), at(4, 2)))
    return rows.select("file", "idx", at(0, 0).alias("focal"), at(0, 1).alias("k1"), at(0, 2).alias("k2"), g.pose_inverse(inner).alias("pose"))


def read_bundle_points(spark: SparkSession, path: str) -> DataFrame:
    """``(file, idx, pos, color, cameras)``: cameras are the numbers of those that see the point."""
    rows = _parted(spark, path).where("part = 1").groupBy("file", "idx").agg(*[F.max(F.when(F.col("row") == k, F.col("line"))).alias(f"l{k}") for k in range(POINT)])
    p, track = _numbers(F.col("l0")), tokens(F.coalesce("l2", F.lit("")))
    c = F.transform(tokens(F.col("l1")), lambda t: t.cast("short"))
    seen = F.coalesce(F.get(track, F.lit(0)).cast("int"), F.lit(0))
    cameras = F.when(seen > 0, F.transform(F.sequence(F.lit(0), seen - 1), lambda i: F.get(track, 1 + 4 * i).cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select("file", "idx", v.vec(*[F.get(p, F.lit(i)) for i in range(3)]).alias("pos"), F.struct(*[F.get(c, F.lit(i)).alias(k) for i, k in enumerate("rgb")]).alias("color"), cameras.alias("cameras"))


def _text(*values: Column) -> Column:
    return F.concat_ws(" ", *[x.cast("string") for x in values])


def write_bundle(cameras: DataFrame, points: DataFrame, path: str, mode: str = "error") -> None:
    """Cameras ``(idx, focal, k1, k2, pose)`` and points ``(idx, pos, color)`` as one file, each in order of ``idx``; tracks are left out."""
    inner = g.pose_inverse(F.col("pose"))
    r, t = g.pose_rotation(inner), g.pose_position(inner)
    turned = [_text(*[v.at(r, i, k) for k in range(3)]) for i in range(3)]
    line = lambda part, lines: [F.lit(part).alias("part"), F.col("idx").cast("long").alias("idx"), F.posexplode(F.array(*lines)).alias("row", "line")]
    spark = cameras.sparkSession
    head = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(("# Bundle file v0.3", f"{cameras.count()} {points.count()}"))], "part int, idx long, row int, line string")
    body = cameras.select(*line(1, [_text(F.col("focal"), F.col("k1"), F.col("k2")), *turned, _text(*v.parts(t))]))
    body = body.unionByName(points.select(*line(2, [_text(*v.parts(F.col("pos"))), _text(*[F.col("color")[k] for k in "rgb"]), F.lit("")])))
    write_lines(head.unionByName(body), path, ["part", "idx", "row"], single=True, mode=mode)


def write_sfm(images: DataFrame, cameras: DataFrame, path: str, points: DataFrame | None = None, mode: str = "error") -> None:
    """Text tables ``images``, ``cameras`` and ``points3D`` in a folder, in the form that :mod:`.poses` reads.

    images: ``(image_id, camera_id, name, pose)``; cameras: ``(camera_id, width, height, intrinsics)``;
    points: ``(id, pos, color)``.
    """
    inner = g.pose_inverse(F.col("pose"))
    q, t = v.matrix_to_quaternion(g.pose_rotation(inner)), g.pose_position(inner)
    own = _text(F.col("image_id"), *[q[k] for k in "wxyz"], *v.parts(t), F.col("camera_id"), F.col("name"))
    lines = images.select(F.col("image_id").alias("n"), F.posexplode(F.array(own, F.lit(""))).alias("row", "line"))
    write_lines(lines, f"{path}/images", ["n", "row"], single=True, mode=mode)
    i = F.col("intrinsics")
    lines = cameras.select(F.col("camera_id").alias("n"), _text(F.col("camera_id"), F.lit("PINHOLE"), F.col("width"), F.col("height"), *[i[k] for k in ("fx", "fy", "cx", "cy")]).alias("line"))
    write_lines(lines, f"{path}/cameras", ["n"], single=True, mode=mode)
    if points is not None:
        lines = points.select(F.col("id").alias("n"), _text(F.col("id"), *v.parts(F.col("pos")), *[F.col("color")[k] for k in "rgb"], F.lit(0)).alias("line"))
        write_lines(lines, f"{path}/points3D", ["n"], single=True, mode=mode)


def with_images(cameras: DataFrame, images: DataFrame, descending: bool = False) -> DataFrame:
    """``cameras`` (numbered by ``idx`` from 0) with ``name``: of the names in ``images``, in order, the one of
    the same number. If there are more of either, reading raises an error."""
    named = with_ordinal(images.select("name"), ["name"], "_up")
    if descending:
        named = named.crossJoin(F.broadcast(named.agg(F.max("_up").alias("_last"))))  # one row
        named = named.select("name", (F.col("_last") - F.col("_up")).alias("_up"))
    both = cameras.join(named, F.col("idx") == F.col("_up"), "full")
    paired = F.col("idx").isNotNull() & F.col("_up").isNotNull()
    name = F.when(paired, F.col("name")).otherwise(F.raise_error(F.lit("images and poses differ in number")).cast("string"))
    return both.select(*cameras.columns, name.alias("name"))


def bundle_to_sfm(spark: SparkSession, bundle: str, images: DataFrame, path: str, width: int, height: int, descending: bool = False, points: bool = True, mode: str = "error") -> None:
    """A bundle file as text tables: an image and a camera (image centre as principal point) for each pose, numbered
    from 1, under the names in ``images``. The two radial terms have no place in a pinhole camera and are left out."""
    cameras = with_images(read_bundle_cameras(spark, bundle), images, descending).withColumn("id", F.col("idx") + 1)
    own = cameras.select(F.col("id").alias("image_id"), F.col("id").alias("camera_id"), "name", "pose")
    values = {"fx": F.col("focal"), "fy": F.col("focal"), "cx": F.lit(width / 2), "cy": F.lit(height / 2)}
    lens = F.struct(*[x.alias(k) for k, x in values.items()])
    lenses = cameras.select(F.col("id").alias("camera_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), lens.alias("intrinsics"))
    dots = read_bundle_points(spark, bundle).select((F.col("idx") + 1).alias("id"), "pos", "color") if points else None
    write_sfm(own, lenses, path, dots, mode)


# --- tables rewritten line by line: what isn't named stays as it is written ---


def _image_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ord, line, n)``: ``n`` numbers the images from 0; comments and the lines after images have none."""
    lines = read_lines(spark, path)
    own = with_ordinal(lines.where(~F.col("line").startswith("#")), ["file", "ord"], "_n")
    own = own.select("file", "ord", "line", F.when(F.col("_n") % 2 == 0, F.floor(F.col("_n") / 2)).alias("n"))
    return own.unionByName(lines.where(F.col("line").startswith("#")).withColumn("n", F.lit(None).cast("long")))


#: A line's first part, its first eight, and what follows these: all that isn't changed is taken over.
ID, BEFORE_TRACK, BEHIND = r"^(\s*\S+)", r"^(\s*(?:\S+\s+){7}\S+)", r"^\s*(?:\S+\s+){8}(.*)$"


def _track(t: Column) -> Column:
    """The pairs of image and point behind the eight first parts of a line; half a pair raises an error."""
    two = lambda i: F.struct(F.get(t, i).try_cast("long").alias("image_id"), F.get(t, i + 1).alias("point2d"))
    pairs = F.transform(F.sequence(F.lit(8), F.greatest(F.size(t) - 2, F.lit(8)), F.lit(2)), two)
    half = F.raise_error(F.lit("a track has half a pair")).cast("array<struct<image_id:bigint,point2d:string>>")
    return F.when((F.size(t) > 8) & (F.size(t) % 2 == 1), half).when(F.size(t) > 8, pairs)


def shift_translations(spark: SparkSession, images: str, path: str, offset: tuple[float, float, float], single: bool = True, mode: str = "error") -> None:
    """An image list with ``offset`` added to the translations as they are written (world to camera)."""
    part = lambda i: F.get(tokens(F.col("line")), F.lit(i))
    moved = [(part(i).cast("double") + offset[i - 5]).cast("string") if 5 <= i <= 7 else part(i) for i in range(8)]
    line = F.when(F.col("n").isNull(), F.col("line")).otherwise(F.concat_ws(" ", *moved, F.regexp_extract("line", BEHIND, 1)))
    write_lines(_image_lines(spark, images).select("file", "ord", line.alias("line")), path, ["file", "ord"], single, mode)


def renumber_sfm(spark: SparkSession, images: str, points: str, path: str, single: bool = True, mode: str = "error") -> None:
    """Tables ``images`` and ``points3D`` under ``path`` in which images are numbered from 1, in order of their lines, and
    the points' tracks say so too. An id of two images, or one in a track that no image has, raises an error.

    Each reference meets the list of ids by a join; a track is put together by its point.
    """
    listed = _image_lines(spark, images)
    old = F.trim(F.regexp_extract("line", ID, 1)).try_cast("long")
    new = F.when(old.isNull(), F.raise_error(F.lit("an image has no number")).cast("string")).otherwise(F.regexp_replace("line", F.lit(ID), (F.col("n") + 1).cast("string")))
    line = F.when(F.col("n").isNull(), F.col("line")).otherwise(new)
    ids = listed.where("n is not null").groupBy(old.alias("image")).agg(F.count("*").alias("_held"), F.min("n").alias("n"))
    once = F.when(F.col("_held") > 1, F.raise_error(F.lit("two images have one id")).cast("long")).otherwise(F.col("n") + 1)
    ids = ids.select("image", once.alias("new"))
    write_lines(listed.select("file", "ord", line.alias("line")), f"{path}/images", ["file", "ord"], single, mode)

    lines = read_lines(spark, points).withColumn("_t", F.when(~F.col("line").startswith("#"), tokens(F.col("line"))))
    spread = lines.select("file", "ord", F.posexplode(_track(F.col("_t"))).alias("at", "p"))
    new = F.when(F.col("new").isNull(), F.raise_error(F.lit("a track names an image that isn't listed")).cast("long")).otherwise(F.col("new"))
    named = spread.join(ids, F.col("p.image_id") == F.col("image"), "left").select("file", "ord", "at", F.concat_ws(" ", new.cast("string"), "p.point2d").alias("two"))
    tracks = named.groupBy("file", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "two"))), lambda x: x["two"]), " ").alias("track"))
    kept = lines.join(tracks, ["file", "ord"], "left")
    line = F.when(F.col("track").isNull(), F.col("line")).otherwise(F.concat_ws(" ", F.regexp_extract("line", BEFORE_TRACK, 1), "track"))
    write_lines(kept.select("file", "ord", line.alias("line")), f"{path}/points3D", ["file", "ord"], single, mode)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """``(id, at, image_id, point2d)``: a row for each image that sees a point of the table, in order of ``at``."""
    t = F.col("_t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(tokens(F.col("value")).alias("_t"))
    return rows.select(F.get(t, F.lit(0)).try_cast("long").alias("id"), F.posexplode(_track(t)).alias("at", "p")).select("id", "at", "p.image_id", F.col("p.point2d").cast("long").alias("point2d"))


def write_transforms(frames: DataFrame, path: str, height: int, width: int, intrinsics: tuple[float, float, float, float], mode: str = "error") -> None:
    """A training-transform JSON of frames ``(file_path, pose)``; they are gathered into one row, as the format asks."""
    matrix = F.array(*[F.slice("pose", 1 + 4 * r, 4) for r in range(3)], F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    one = frames.agg(F.array_sort(F.collect_list(F.struct("file_path", matrix.alias("transform_matrix")))).alias("frames"))
    fx, fy, cx, cy = intrinsics
    values = {"h": height, "w": width, "fl_x": fx, "fl_y": fy, "cx": cx, "cy": cy}
    one.select(*[F.lit(x).alias(k) for k, x in values.items()], "frames").coalesce(1).write.mode(mode).json(path)


def write_crop(crops: DataFrame, path: str, mode: str = "error") -> None:
    """Crops ``(center, size, orientation)`` as JSON, one to a line."""
    xyz = lambda c: F.array(*v.parts(F.col(c))).alias(c)
    turned = F.array(*[F.slice("orientation", 1 + 3 * r, 3) for r in range(3)]).alias("orientation")
    crops.select(xyz("center"), xyz("size"), turned).write.mode(mode).json(path)
