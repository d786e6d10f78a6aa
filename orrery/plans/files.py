"""Writers and readers: what is written from a table comes back the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import binning
from ..operators.collections import with_ordinal
from ..registry import query, table
from ..sources import bundle, documents, lines, ply, points, poses
from ..storage import work_dir
from .spatial import points as embedded
from .spatial import terrain


def place(spark, name: str) -> str:
    return f"{work_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


@query("file_points", """
SELECT l_quantity AS x, round(l_discount * 100) AS y, l_extendedprice AS z, l_tax AS tax FROM lineitem WHERE l_quantity > 40""")
def file_points(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity > 40")
    rows = rows.select(v.vec("l_quantity", F.round(F.col("l_discount") * 100), "l_extendedprice").alias("pos"), F.col("l_tax").alias("tax"))
    points.write_points(rows, at := place(spark, "points"))
    found = points.read_points(spark, at, points.PointLayout(doubles={"tax": 3}))
    return found.select("pos.x", "pos.y", "pos.z", "tax")


@query("file_lines", "SELECT p_partkey AS ord, p_name AS line FROM part")
def file_lines(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("line"))
    lines.write_lines(rows, at := place(spark, "lines"), ["ord"], single=True)
    return lines.read_lines(spark, at).select("ord", "line")


@query("file_matrix", "SELECT p_partkey AS row, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part")
def file_matrix(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("line"))
    lines.write_lines(rows, at := place(spark, "matrix"), ["ord"], single=True)
    return lines.read_matrix(spark, at).select("row", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


@query("file_bins", "SELECT CAST(CAST(trunc(value / 10.0) AS BIGINT) AS DOUBLE) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1")
def file_bins(spark, d):
    points.write_bins(binning.histogram(table(spark, d, "events"), "value", 10.0), at := place(spark, "bins"), ["bin", "weight"])
    return points.read_bins(spark, at, ["bin", "weight"])


@query("file_poses", """
SELECT vec_id AS ts, round(CAST(embedding[2] AS DOUBLE), 9) AS x, round(cos(CAST(embedding[1] AS DOUBLE)), 9) AS r00, round(-sin(CAST(embedding[1] AS DOUBLE)), 9) AS r01 FROM embeddings""")
def file_poses(spark, d):
    p = F.col("pos")
    rows = embedded(spark, d).select(F.col("id").alias("ts"), g.pose(v.rotation_z(p["x"]), v.vec(p["y"], p["z"], 1.0)).alias("pose"))
    poses.write_poses(rows, at := place(spark, "poses"), "quaternion")
    back = poses.read_poses(spark, at, "quaternion")
    return back.select("ts", F.round(g.pose_position(F.col("pose"))["x"], 9).alias("x"), *[F.round(F.get("pose", F.lit(i)), 9).alias(f"r0{i}") for i in (0, 1)])


@query("file_ply", """
SELECT vec_id AS face_id, vec_id * 3 AS v1, round(CAST(embedding[1] AS DOUBLE), 9) AS x, round(CAST(embedding[3] AS DOUBLE), 9) AS z FROM embeddings""")
def file_ply(spark, d):
    t = F.col("tri")
    corner = terrain(spark, d).select("id", F.posexplode(F.array(t["a"], t["b"], t["c"])).alias("k", "p"))
    vertices = corner.select((F.col("id") * 3 + F.col("k")).alias("vertex_id"), "p.x", "p.y", "p.z")
    faces = embedded(spark, d).select(F.col("id").alias("face_id"), *[(F.col("id") * 3 + k).alias(f"v{k + 1}") for k in range(3)])
    ply.write_ply(vertices, at := place(spark, "ply"), faces)
    v_back, f_back = ply.read_ply(spark, at, columns=["x", "z"]), ply.read_ply(spark, at, "face")
    both = f_back.join(v_back, F.col("v1") == F.col("vertex_id"))
    return both.select("face_id", "v1", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query("file_ply_binary", """
SELECT p_partkey AS face_id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS FLOAT) AS price, CAST(p_partkey % 7 AS INTEGER) AS kind, CAST(p_partkey % 256 AS SMALLINT) AS red FROM part""")
def file_ply_binary(spark, d):
    """Three vertices a part, of which the ids have gaps; a face of them; read back in ranges of 4 kB."""
    parts = table(spark, d, "part")
    key = F.col("p_partkey").cast("long")
    corner = parts.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    vertices = corner.select((key * 10 + F.col("k")).alias("vertex_id"), F.col("p_size").cast("double").alias("x"), F.col("k").cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("p_retailprice").cast("float").alias("price"), (key % 256).cast("short").alias("red"))
    faces = parts.select(key.alias("face_id"), *[(key * 10 + k).alias(f"v{k + 1}") for k in range(3)], (key % 7).cast("int").alias("kind"))
    ply.write_ply_binary(vertices, at := place(spark, "binary") + ".ply", faces)
    v_back, f_back = ply.read_ply(spark, at, range_bytes=4096), ply.read_ply(spark, at, "face", range_bytes=4096)
    both = f_back.join(v_back, F.col("v2") == F.col("vertex_id")).where("y = 1 and v3 = v2 + 1")
    return both.select("face_id", "x", "price", "kind", F.col("red").cast("short").alias("red"))


ROUND = "round(CAST({} AS DOUBLE), 9)"


@query("file_bundle", f"""
WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx, {ROUND.format('embedding[1]')} AS x, {ROUND.format('embedding[3]')} AS z, {ROUND.format('cos(embedding[1]::DOUBLE)')} AS r00 FROM embeddings)
SELECT 'camera' AS kind, idx, x, z, r00 AS other FROM p WHERE vec_id % 50 = 0 UNION ALL SELECT 'point', idx, x, z, CAST(vec_id % 256 AS DOUBLE) FROM p""".replace("SELECT 'camera' AS kind, idx", "SELECT 'camera' AS kind, row_number() OVER (ORDER BY vec_id) - 1 AS idx"))
def file_bundle(spark, d):
    p = F.col("pos")
    rows = embedded(spark, d)
    ranked = lambda df: with_ordinal(df, ["id"], "idx")
    cameras = ranked(rows.where("id % 50 = 0")).select("idx", F.lit(500.0).alias("focal"), F.lit(0.0).alias("k1"), F.lit(0.0).alias("k2"), g.pose(v.rotation_z(p["x"]), p).alias("pose"))
    dots = ranked(rows).select("idx", "pos", F.struct(*[(F.col("id") % 256).cast("short").alias(k) for k in "rgb"]).alias("color"))
    bundle.write_bundle(cameras, dots, at := place(spark, "bundle"))
    seen = bundle.read_bundle_cameras(spark, at)
    at_ = lambda a: F.round(g.pose_position(F.col("pose"))[a], 9).alias(a)
    seen = seen.select(F.lit("camera").alias("kind"), "idx", at_("x"), at_("z"), F.round(F.get("pose", F.lit(0)), 9).alias("other"))
    back = bundle.read_bundle_points(spark, at)
    return seen.unionByName(back.select(F.lit("point").alias("kind"), "idx", F.round("pos.x", 9).alias("x"), F.round("pos.z", 9).alias("z"), F.col("color.r").cast("double").alias("other")))


@query("file_sfm", f"SELECT vec_id AS image_id, {ROUND.format('embedding[2]')} AS y, {ROUND.format('cos(embedding[1]::DOUBLE)')} AS r00, 640 AS width FROM embeddings")
def file_sfm(spark, d):
    p = F.col("pos")
    images = embedded(spark, d).select(F.col("id").alias("image_id"), F.lit(1).alias("camera_id"), F.concat(F.lit("image"), "id").alias("name"), g.pose(v.rotation_z(p["x"]), p).alias("pose"))
    lens = F.struct(*[F.lit(x).alias(k) for k, x in (("fx", 500.0), ("fy", 500.0), ("cx", 320.0), ("cy", 240.0))]).alias("intrinsics")
    cameras = spark.range(1).select(F.lit(1).alias("camera_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), lens)
    bundle.write_sfm(images, cameras, at := place(spark, "sfm"))
    back = poses.trajectory(poses.read_images(spark, f"{at}/images"), poses.read_cameras(spark, f"{at}/cameras"))
    return back.select(F.col("image_id").cast("long").alias("image_id"), F.round(g.pose_position(F.col("pose"))["y"], 9).alias("y"), F.round(F.get("pose", F.lit(0)), 9).alias("r00"), "width")


@query("file_sfm_renumbered", """
WITH i AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id DESC) AS new, count(*) OVER () AS n FROM embeddings),
t AS (SELECT id, unnest([0, 1, 2]) AS at, n FROM i)
SELECT t.id, t.at, i.new AS image_id, t.at * 10 AS point2d FROM t JOIN i ON i.id = CASE WHEN t.at = 2 THEN 0 ELSE t.id END""")
def file_sfm_renumbered(spark, d):
    """Images in falling order of ids with gaps; each point is seen twice by its own and by the one that sees all."""
    n = (F.col("id") * 7 + 3).cast("string")
    listed = embedded(spark, d).select("id", F.posexplode(F.array(F.concat_ws(" ", n, F.lit("1 0 0 0 0 0 0 1"), F.concat(F.lit("image"), n)), F.lit("5 6 -1"))).alias("row", "line"))
    at = place(spark, "renumbered")
    lines.write_lines(listed.withColumn("back", -F.col("id")), f"{at}/old/images", ["back", "row"], single=True)
    dots = embedded(spark, d).select("id", F.concat_ws(" ", F.col("id").cast("string"), F.lit("1 2 3 9 9 9 0.5"), n, F.lit("0"), n, F.lit("10 3 20")).alias("line"))
    lines.write_lines(dots, f"{at}/old/points3D", ["id"], single=True)
    bundle.renumber_sfm(spark, f"{at}/old/images", f"{at}/old/points3D", f"{at}/new")
    return bundle.read_tracks(spark, f"{at}/new/points3D")


@query("file_bundle_to_sfm", f"""
SELECT row_number() OVER (ORDER BY vec_id) AS image_id, 'image' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS name, {ROUND.format('embedding[2]')} AS y, 500.0::DOUBLE + vec_id AS fx, 320.0::DOUBLE AS cx FROM embeddings""")
def file_bundle_to_sfm(spark, d):
    p = F.col("pos")
    rows = with_ordinal(embedded(spark, d), ["id"], "idx")
    cameras = rows.select("idx", (F.col("id") + 500.0).alias("focal"), F.lit(0.0).alias("k1"), F.lit(0.0).alias("k2"), g.pose(v.rotation_z(p["x"]), p).alias("pose"))
    dots = rows.select("idx", "pos", F.struct(*[F.lit(9).cast("short").alias(k) for k in "rgb"]).alias("color"))
    at = place(spark, "to-sfm")
    bundle.write_bundle(cameras, dots, f"{at}/bundle")
    bundle.bundle_to_sfm(spark, f"{at}/bundle", rows.select(F.concat(F.lit("image"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name")), f"{at}/sfm", 640, 480, points=False)
    back = poses.trajectory(poses.read_images(spark, f"{at}/sfm/images"), poses.read_cameras(spark, f"{at}/sfm/cameras"))
    return back.select(F.col("image_id").cast("long").alias("image_id"), "name", F.round(g.pose_position(F.col("pose"))["y"], 9).alias("y"), "intrinsics.fx", "intrinsics.cx")


@query("file_json_points", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS y FROM part")
def file_json_points(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, v.vec("p_size", "p_retailprice", 1.0)).alias("pos"))
    documents.write_points_json(rows, at := place(spark, "json"), ["p_partkey"])
    return documents.read_points_json(spark, at).select("ord", "pos.x", "pos.y")


@query("file_results", """
SELECT o_orderkey AS frame, count(*) AS n_pixels, CAST(CAST(avg(l_discount) AS DECIMAL(18, 4)) AS DOUBLE) AS mean_noise_m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 GROUP BY 1 HAVING count(*) IN (1, 2, 4, 5)""")
def file_results(spark, d):
    """Numbers of lines by which means come out in few digits, so that their rounding is not in doubt."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.count("*").alias("n_pixels"), F.avg("l_discount").alias("mean_noise_m")).where("n_pixels in (1, 2, 4, 5)")
    documents.write_results(rows, at := place(spark, "results"), ["frame", "n_pixels", "mean_noise_m"], ["frame"])
    return documents.read_results(spark, at, "frame long, n_pixels long, mean_noise_m double")


@query("file_cameras", "SELECT vec_id AS camera_id, 640 AS width, round(CAST(embedding[1] AS DOUBLE) + 500, 9) AS fx, round(CAST(embedding[2] AS DOUBLE), 9) AS k1, 0.0::DOUBLE AS k2, round(CAST(embedding[3] AS DOUBLE), 9) AS z FROM embeddings")
def file_cameras(spark, d):
    p = F.col("pos")
    lens = F.struct((p["x"] + 500).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"))
    cameras = embedded(spark, d).select(F.col("id").alias("camera_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), lens.alias("intrinsics"), g.pose(v.rotation_z(p["x"]), p).alias("pose"), p["y"].alias("k1"))
    documents.write_cameras(cameras, at := place(spark, "cameras"))
    back = documents.read_cameras(spark, at)
    return back.select("camera_id", "width", F.round("intrinsics.fx", 9).alias("fx"), F.round("k1", 9).alias("k1"), "k2", F.round(g.pose_position(F.col("pose"))["z"], 9).alias("z"))
