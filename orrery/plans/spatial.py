"""Boxes, nearest neighbours, rays and voxels, with stand-ins for geometry drawn from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import cells, mesh, spatial, voxel
from ..registry import query, table


def points(spark, d) -> DataFrame:
    """The first three values of each embedding as a point."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.vec(at(0), at(1), at(2)).alias("pos"), "label")


def many_points(spark, d) -> DataFrame:
    """Order lines as points of a lattice."""
    return table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("id"), v.vec("l_quantity", F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)).alias("pos")
    )


def boxes(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), g.box_from_center(v.vec("p_size", k % 11, k % 9), v.vec(k % 3 + 1, 1.0, 1.0)).alias("box"))


POINTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
BOXES = """b AS (SELECT p_partkey AS id, p_size - (p_partkey % 3 + 1) / 2 AS x0, p_size + (p_partkey % 3 + 1) / 2 AS x1, p_partkey % 11 - 0.5 AS y0, p_partkey % 11 + 0.5 AS y1,
    p_partkey % 9 - 0.5 AS z0, p_partkey % 9 + 0.5 AS z1 FROM part)"""


@query("box_contains", f"""
WITH {BOXES}, q AS (SELECT l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT id, CAST(sum(n) AS BIGINT) AS points FROM b JOIN q ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1 GROUP BY id""")
def box_contains(spark, d):
    return spatial.count_points(many_points(spark, d), boxes(spark, d), 1.0).select(F.col("box_id").alias("id"), F.col("n").alias("points"))


@query("box_overlap", f"""
WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id FROM b AS a JOIN b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1
WHERE a.id % 50 = 0""")
def box_overlap(spark, d):
    """A search: every 50th box against all."""
    b = boxes(spark, d)
    return spatial.boxes_meeting(b.where("id % 50 = 0"), b, strict=True).where("a_id < b_id")


@query("box_overlap_whole", f"""
WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id FROM b AS a JOIN b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1""")
def box_overlap_whole(spark, d):
    b = boxes(spark, d)
    return spatial.boxes_meeting(b, b, strict=True).where("a_id < b_id")


@query("box_intersect", f"""
WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id FROM b AS a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1
WHERE a.id % 50 = 0""")
def box_intersect(spark, d):
    """A search: every 50th box against all."""
    b = boxes(spark, d)
    return spatial.boxes_meeting(b.where("id % 50 = 0"), b)


@query("box_intersect_whole", f"""
WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id FROM b AS a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1""")
def box_intersect_whole(spark, d):
    b = boxes(spark, d)
    return spatial.boxes_meeting(b, b)


@query("box_any", f"""
WITH {BOXES} SELECT id FROM b WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_quantity BETWEEN x0 AND x1 AND round(l_discount * 100) BETWEEN y0 AND y1 AND round(l_tax * 100) BETWEEN z0 AND z1)""")
def box_any(spark, d):
    return spatial.any_in_box(boxes(spark, d), many_points(spark, d)).select("id")


@query("box_measures", f"""
WITH {BOXES} SELECT id, round(CAST((x1 - x0) * (y1 - y0) * (z1 - z0) AS DOUBLE), 8) AS volume, round(CAST((x0 + x1) / 2 AS DOUBLE), 8) AS center_x,
    round(sqrt(greatest(x0 - 25, 0, 25 - x1) ** 2 + greatest(y0 - 5, 0, 5 - y1) ** 2 + greatest(z0 - 4, 0, 4 - z1) ** 2), 7) AS distance FROM b""")
def box_measures(spark, d):
    b = F.col("box")
    return boxes(spark, d).select("id", F.round(g.box_volume(b), 8).alias("volume"), F.round(g.box_center(b)["x"], 8).alias("center_x"), F.round(g.box_distance(b, v.vec(25.0, 5.0, 4.0)), 7).alias("distance"))


@query("box_difference", f"""
WITH {BOXES}, o AS (SELECT *, greatest(0, least(x1, 30) - greatest(x0, 20)) * greatest(0, least(y1, 7) - greatest(y0, 2)) * greatest(0, least(z1, 6) - greatest(z0, 1)) AS shared FROM b)
SELECT id, round(CAST((x1 - x0) * (y1 - y0) * (z1 - z0) - shared AS DOUBLE), 8) AS volume FROM o WHERE (x1 - x0) * (y1 - y0) * (z1 - z0) - shared > 0""")
def box_difference(spark, d):
    cut = g.box(v.vec(20.0, 2.0, 1.0), v.vec(30.0, 7.0, 6.0))
    left = boxes(spark, d).select("id", F.explode(g.box_difference(F.col("box"), cut)).alias("rest"))
    return left.groupBy("id").agg(F.round(F.sum(g.box_volume(F.col("rest"))), 8).alias("volume"))


#: All bounds are multiples of a half, so boxes are sets of cells of half a unit; cutters stand on the boxes' upper corners.
CELLS_LEFT = f"""WITH {BOXES}, c AS (SELECT id, unnest(generate_series(CAST(2 * x0 AS INT), CAST(2 * x1 AS INT) - 1)) AS i, y0, y1, z0, z1 FROM b {{0}}),
e AS (SELECT id, i, unnest(generate_series(CAST(2 * y0 AS INT), CAST(2 * y1 AS INT) - 1)) AS j, z0, z1 FROM c), f AS (SELECT id, i, j, unnest(generate_series(CAST(2 * z0 AS INT), CAST(2 * z1 AS INT) - 1)) AS k FROM e),
gone AS (SELECT DISTINCT CAST(2 * x1 AS INT) + dx AS i, CAST(2 * y1 AS INT) + dy AS j, CAST(2 * z1 AS INT) + dz AS k FROM b, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz))
SELECT id, count(*) / 8.0::DOUBLE AS volume FROM f ANTI JOIN gone USING (i, j, k) GROUP BY id"""


def clipped(boxes_: DataFrame, all_boxes: DataFrame) -> DataFrame:
    """What is left of each box outside all unit boxes set beside the others' upper corners."""
    top = F.col("box")["max"]
    left = spatial.clip_boxes(boxes_, all_boxes.withColumn("box", g.box(top, v.vec(top["x"] + 1, top["y"] + 1, top["z"] + 1))))
    return left.groupBy("id").agg(F.round(F.sum(g.box_volume(F.col("box"))), 8).alias("volume"))


@query("boxes_clipped", CELLS_LEFT.format("WHERE id % 50 = 0"))
def boxes_clipped(spark, d):
    b = boxes(spark, d)
    return clipped(b.where("id % 50 = 0"), b)


@query("boxes_clipped_whole", CELLS_LEFT.format(""))
def boxes_clipped_whole(spark, d):
    b = boxes(spark, d)
    return clipped(b, b)


@query("bounds", f"""
WITH {POINTS} SELECT label, round(min(x), 8) AS low_x, round(max(y), 8) AS high_y, round(avg(z), 8) AS centroid_z, count(*) AS n FROM p GROUP BY label""")
def bounds(spark, d):
    b = spatial.bounds(points(spark, d), by=["label"])
    return b.select("label", F.round("box.min.x", 8).alias("low_x"), F.round("box.max.y", 8).alias("high_y"), F.round("centroid.z", 8).alias("centroid_z"), "n")


@query("fit_into_box", f"""
WITH {POINTS}, m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT id, round((x - (x0 + x1) / 2) / (x1 - x0) * 4 + 3, 8) AS x, round((y - (y0 + y1) / 2) / (y1 - y0) * 2, 8) AS y FROM p, m""")
def fit_into_box(spark, d):
    moved = spatial.fit_into(points(spark, d), (1, -1, 0), (5, 1, 1))
    return moved.select("id", F.round("pos.x", 8).alias("x"), F.round("pos.y", 8).alias("y"))


@query("rotate_about_centroid", f"""
WITH {POINTS}, m AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p)
SELECT id, round((x - cx) * cos(0.5) - (y - cy) * sin(0.5) + cx, 8) AS x, round((x - cx) * sin(0.5) + (y - cy) * cos(0.5) + cy, 8) AS y FROM p, m""")
def rotate_about_centroid(spark, d):
    moved = spatial.rotate_about_centroid(points(spark, d), v.rotation_z(0.5))
    return moved.select("id", F.round("pos.x", 8).alias("x"), F.round("pos.y", 8).alias("y"))


@query("nn_filtered", f"""
WITH {POINTS}, m AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.label <> b.label)
SELECT id, other AS nearest, round(d, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM m WHERE d <= 0.1) WHERE k = 1""")
def nn_filtered(spark, d):
    p = points(spark, d)
    return spatial.nearest(p, p, max_distance=0.1, apart="label").select(F.col("query_id").alias("id"), F.col("point_id").alias("nearest"), F.round("distance", 8).alias("distance"))


@query("nn_unbounded", f"""
WITH {POINTS}, m AS (SELECT a.id, b.id AS other, sqrt((2 * a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a CROSS JOIN p b WHERE a.id % 50 = 0)
SELECT id, other AS nearest, round(d, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM m) WHERE k = 1""")
def nn_unbounded(spark, d):
    p = points(spark, d)
    asked = p.where("id % 50 = 0").withColumn("pos", v.vec(F.col("pos.x") * 2, F.col("pos.y"), F.col("pos.z")))
    return spatial.nearest(asked, p).select(F.col("query_id").alias("id"), F.col("point_id").alias("nearest"), F.round("distance", 8).alias("distance"))


@query("nn_unbounded_whole", f"""
WITH {POINTS}, m AS (SELECT a.id, b.id AS other, sqrt((2 * a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a CROSS JOIN p b)
SELECT id, other AS nearest, round(d, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM m) WHERE k = 1""")
def nn_unbounded_whole(spark, d):
    p = points(spark, d)
    asked = p.withColumn("pos", v.vec(F.col("pos.x") * 2, F.col("pos.y"), F.col("pos.z")))
    return spatial.nearest(asked, p).select(F.col("query_id").alias("id"), F.col("point_id").alias("nearest"), F.round("distance", 8).alias("distance"))


def terrain(spark, d) -> DataFrame:
    """Small triangles, one over each point."""
    p = F.col("pos")
    corner = lambda dx, dy: v.vec(p["x"] + dx, p["y"] + dy, p["z"])
    return points(spark, d).select("id", g.triangle(corner(0.0, 0.0), corner(0.05, 0.01), corner(0.01, 0.05)).alias("tri"))


@query("ray_first_hits", f"""
WITH {POINTS}, r AS (SELECT id, x + 0.01 AS ox, y + 0.012 AS oy FROM p), h AS (SELECT r.id AS ray_id, t.id AS triangle_id, t.z + 2 AS d,
    0.05 * (oy - t.y) - 0.01 * (ox - t.x) AS s1, -0.04 * (oy - t.y - 0.01) - 0.04 * (ox - t.x - 0.05) AS s2, -0.01 * (oy - t.y - 0.05) + 0.05 * (ox - t.x - 0.01) AS s3 FROM r CROSS JOIN p AS t)
SELECT ray_id, triangle_id, round(d, 7) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY d, triangle_id) AS k FROM h WHERE s1 > 0 AND s2 > 0 AND s3 > 0) WHERE k = 1""")
def ray_first_hits(spark, d):
    p = F.col("pos")
    rays = points(spark, d).select("id", g.ray(v.vec(p["x"] + 0.01, p["y"] + 0.012, -2.0), v.vec(0.0, 0.0, 1.0)).alias("ray"))
    return spatial.ray_hits(rays, terrain(spark, d)).select("ray_id", "triangle_id", F.round("distance", 7).alias("distance"))


#: The terrain's triangles are level: a ray is at (ox + 0.5 (z + 2), oy + 0.25 (z + 2)) where it meets their plane.
@query("ray_all_hits", f"""
WITH {POINTS}, h AS (SELECT r.id AS ray_id, t.id AS triangle_id, t.z + 2 AS up, r.x - 1 + 0.5 * (t.z + 2) - t.x AS u, r.y - 0.5 + 0.25 * (t.z + 2) - t.y AS w FROM p AS r CROSS JOIN p AS t WHERE t.z + 2 >= 0)
SELECT ray_id, triangle_id, round(up * sqrt(1.3125), 7) AS distance FROM h
WHERE 0.05 * w - 0.01 * u > 0 AND -0.04 * (w - 0.01) - 0.04 * (u - 0.05) > 0 AND -0.01 * (w - 0.05) + 0.05 * (u - 0.01) > 0""")
def ray_all_hits(spark, d):
    p = F.col("pos")
    rays = points(spark, d).select("id", g.ray(v.vec(p["x"] - 1, p["y"] - 0.5, -2.0), v.vec(0.5, 0.25, 1.0)).alias("ray"))
    return spatial.ray_hits(rays, terrain(spark, d), first_only=False).select("ray_id", "triangle_id", F.round("distance", 7).alias("distance"))


@query("ray_box", f"""
WITH {BOXES}, t AS (SELECT id, greatest((x0 - 0) / 0.6, (y0 + 4) / 0.8) AS near, least((x1 - 0) / 0.6, (y1 + 4) / 0.8) AS far, z0, z1 FROM b)
SELECT id, round(CAST(near AS DOUBLE), 7) AS entry, round(CAST(far AS DOUBLE), 7) AS exit FROM t WHERE near <= far AND near > 0 AND z0 < 4.2 AND z1 > 4.2""")
def ray_box(spark, d):
    r = g.ray(v.vec(0.0, -4.0, 4.2), v.vec(3.0, 4.0, 0.0))
    hits = boxes(spark, d).select("id", g.ray_box_hits(r, F.col("box")).alias("h")).where("size(h) = 2")
    return hits.select("id", F.round(F.get("h", F.lit(0)), 7).alias("entry"), F.round(F.get("h", F.lit(1)), 7).alias("exit"))


def _edge(ax, ay, bx, by) -> str:
    """SQL: the squared distance in the plane from (u, w) to a segment."""
    along = f"least(1, greatest(0, ((u - {ax}) * {bx - ax} + (w - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2}))"
    return f"((u - {ax} - {bx - ax} * {along}) ** 2 + (w - {ay} - {by - ay} * {along}) ** 2)"


@query("nearest_triangle", f"""
WITH {POINTS}, h AS (SELECT q.id AS point_id, t.id AS triangle_id, q.x + 0.02 - t.x AS u, q.y + 0.02 - t.y AS w, q.z + 0.03 - t.z AS up FROM p AS q JOIN p AS t ON abs(q.z + 0.03 - t.z) <= 0.05),
e AS (SELECT *, CASE WHEN 0.05 * w - 0.01 * u >= 0 AND -0.04 * (w - 0.01) - 0.04 * (u - 0.05) >= 0 AND -0.01 * (w - 0.05) + 0.05 * (u - 0.01) >= 0 THEN 0
    ELSE least({_edge(0.0, 0.0, 0.05, 0.01)}, {_edge(0.05, 0.01, 0.01, 0.05)}, {_edge(0.01, 0.05, 0.0, 0.0)}) END AS flat FROM h),
d AS (SELECT point_id, triangle_id, sqrt(flat + up * up) AS distance FROM e)
SELECT point_id, triangle_id, round(distance, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, triangle_id) AS k FROM d WHERE distance <= 0.05) WHERE k = 1""")
def nearest_triangle(spark, d):
    found = spatial.nearest_triangle(points(spark, d).withColumn("pos", v.add(F.col("pos"), v.vec(0.02, 0.02, 0.03))), terrain(spark, d), 0.05)
    return found.select("point_id", "triangle_id", F.round("distance", 8).alias("distance"))


VOXELS = f"""{POINTS}, o AS (SELECT min(x) - 0.1 AS ox, min(y) - 0.1 AS oy, min(z) - 0.1 AS oz FROM p), u AS (SELECT p.*, (x - ox) / 0.1 AS ux, (y - oy) / 0.1 AS uy, (z - oz) / 0.1 AS uz FROM p, o),
a AS (SELECT *, unnest(generate_series(CAST(ceil(ux - 0.5) AS BIGINT), CAST(floor(ux + 0.5) AS BIGINT))) AS vx FROM u),
b AS (SELECT *, unnest(generate_series(CAST(ceil(uy - 0.5) AS BIGINT), CAST(floor(uy + 0.5) AS BIGINT))) AS vy FROM a),
c AS (SELECT *, unnest(generate_series(CAST(ceil(uz - 0.5) AS BIGINT), CAST(floor(uz + 0.5) AS BIGINT))) AS vz FROM b)"""


@query("voxel_counts", f"WITH {VOXELS} SELECT vx, vy, vz, count(*) AS n FROM c GROUP BY vx, vy, vz")
def voxel_counts(spark, d):
    return voxel.occupancy(points(spark, d), 0.1)


@query("voxel_subsample", f"""
WITH {VOXELS} SELECT vx, vy, vz, count(*) AS n, round(avg(x), 8) AS x, round(avg(y), 8) AS y, round(avg(z), 8) AS z, min(label) AS label FROM c GROUP BY vx, vy, vz HAVING count(*) >= 2""")
def voxel_subsample(spark, d):
    found = voxel.subsample(points(spark, d), 0.1, 2, {"label": F.min("label")})
    return found.select("vx", "vy", "vz", "n", *[F.round(F.col("pos")[a], 8).alias(a) for a in v.AXES], "label")


@query("voxel_grid_size", f"""
WITH {POINTS} SELECT CAST(ceil((max(x) - min(x) + 0.2) / 0.1) AS BIGINT) AS nx, CAST(ceil((max(y) - min(y) + 0.2) / 0.1) AS BIGINT) AS ny, CAST(ceil((max(z) - min(z) + 0.2) / 0.1) AS BIGINT) AS nz FROM p""")
def voxel_grid_size(spark, d):
    return voxel.grid_size(points(spark, d), 0.1)


@query("voxel_boundary", """
WITH q AS (SELECT l_quantity AS x, round(l_discount * 100) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, unnest(generate_series(CAST(ceil(x / 2 - 0.5) AS BIGINT), CAST(floor(x / 2 + 0.5) AS BIGINT))) AS vx FROM q),
b AS (SELECT *, unnest(generate_series(CAST(ceil(y / 2 - 0.5) AS BIGINT), CAST(floor(y / 2 + 0.5) AS BIGINT))) AS vy FROM a)
SELECT vx, vy, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY vx, vy""")
def voxel_boundary(spark, d):
    flat = many_points(spark, d).withColumn("pos", v.vec(F.col("pos.x"), F.col("pos.y"), 0.0))
    return voxel.occupancy(flat, 2.0, (0.0, 0.0, 0.0)).select("vx", "vy", "n")


#: A level triangle meets a cube if it lies at its height and no edge of either parts them in the plane.
@query("triangle_voxels", f"""
WITH {POINTS}, t AS (SELECT id, (x + 1) / 0.05 AS x, (y + 1) / 0.05 AS y, (z + 1) / 0.05 AS z FROM p),
a AS (SELECT *, unnest(generate_series(CAST(ceil(x - 0.5) AS BIGINT), CAST(floor(x + 1.5) AS BIGINT))) AS vx FROM t), b AS (SELECT *, unnest(generate_series(CAST(ceil(y - 0.5) AS BIGINT), CAST(floor(y + 1.5) AS BIGINT))) AS vy FROM a),
c AS (SELECT *, unnest(generate_series(CAST(ceil(z - 0.5) AS BIGINT), CAST(floor(z + 0.5) AS BIGINT))) AS vz, vx - x AS u, vy - y AS w FROM b)
SELECT id, vx, vy, vz FROM c WHERE 1.0 * w - 0.2 * u >= -0.6 AND -0.8 * (w - 0.2) - 0.8 * (u - 1.0) >= -0.8 AND -0.2 * (w - 1.0) + 1.0 * (u - 0.2) >= -0.6""")
def triangle_voxels(spark, d):
    return voxel.voxelize_triangles(terrain(spark, d), 0.05, (-1.0, -1.0, -1.0)).select("id", "vx", "vy", "vz")


@query("mesh_measures", f"""
WITH {POINTS} SELECT id, round(CAST(0.0012 AS DOUBLE), 9) AS area, round(x + 0.02, 8) AS centroid_x, 1.0::DOUBLE AS normal_z FROM p""")
def mesh_measures(spark, d):
    t = F.col("tri")
    corner = terrain(spark, d).select("id", F.posexplode(F.array(t["a"], t["b"], t["c"])).alias("k", "pos"))
    vertices = corner.select((F.col("id") * 3 + F.col("k")).alias("vertex_id"), "pos")
    faces = points(spark, d).select(F.col("id").alias("face_id"), *[(F.col("id") * 3 + k).alias(f"v{k + 1}") for k in range(3)])
    m = mesh.measures(mesh.triangles(vertices, faces))
    return m.select("id", F.round("area", 9).alias("area"), F.round("centroid.x", 8).alias("centroid_x"), F.round("normal.z", 8).alias("normal_z"))


def occupied(spark, d) -> DataFrame:
    """Cells of a grid in which a multiple of three order lines fall."""
    at = [(F.col("l_quantity") / 2).cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z")]
    return table(spark, d, "lineitem").groupBy(*at).agg(F.count("*").alias("n")).where("n % 3 = 0").drop("n")


OCCUPIED = """o AS (SELECT x, y, z FROM (SELECT CAST(trunc(l_quantity / 2) AS INTEGER) AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(round(l_tax * 100) AS INTEGER) AS z, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3) WHERE n % 3 = 0)"""
SPREAD = f"{POINTS}, s AS (SELECT id, 10 * x + 12 AS x, 10 * y + 5 AS y, 10 * z + 4 AS z FROM p)"


def spread(spark, d) -> DataFrame:
    """Points strewn over that grid and around it."""
    p = F.col("pos")
    return points(spark, d).select("id", v.vec(10 * p["x"] + 12, 10 * p["y"] + 5, 10 * p["z"] + 4).alias("pos"))


@query("cells_nearest", f"""
WITH {SPREAD}, {OCCUPIED}, m AS (SELECT s.id, o.x, o.y, o.z, sqrt(greatest(abs(s.x - o.x) - 0.5, 0) ** 2 + greatest(abs(s.y - o.y) - 0.5, 0) ** 2 + greatest(abs(s.z - o.z) - 0.5, 0) ** 2) AS d FROM s, o)
SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, round(d, 8) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, x, y, z) AS k FROM m) WHERE k = 1""")
def cells_nearest(spark, d):
    found = cells.nearest_cells(spread(spark, d), occupied(spark, d))
    return found.select(F.col("point_id").alias("id"), "x", "y", "z", F.round("distance", 8).alias("distance"))


@query("cells_in_boxes", f"""
WITH {BOXES}, {OCCUPIED} SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM b, o
WHERE id % 50 = 0 AND x0 <= x + 0.5 AND x - 0.5 <= x1 AND y0 <= y + 0.5 AND y - 0.5 <= y1 AND z0 <= z + 0.5 AND z - 0.5 <= z1""")
def cells_in_boxes(spark, d):
    found = cells.cells_in_boxes(boxes(spark, d).where("id % 50 = 0"), occupied(spark, d))
    return found.withColumnRenamed("box_id", "id")


@query("cells_first_hit", f"""
WITH {SPREAD}, {OCCUPIED}, r AS (SELECT id, s.x, s.y, s.z, 2.0 / 3 AS dx, 1.0 / 3 AS dy, -2.0 / 3 AS dz FROM s),
h AS (SELECT id, o.x AS cx, o.y AS cy, o.z AS cz, greatest((o.x - 0.5 - r.x) / dx, (o.y - 0.5 - r.y) / dy, (o.z + 0.5 - r.z) / dz) AS near,
    least((o.x + 0.5 - r.x) / dx, (o.y + 0.5 - r.y) / dy, (o.z - 0.5 - r.z) / dz) AS far FROM r, o),
m AS (SELECT *, CASE WHEN near > 0 THEN near ELSE far END AS d FROM h WHERE far >= 0 AND near <= far)
SELECT id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y, CAST(cz AS BIGINT) AS z, round(d, 7) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cx, cy, cz) AS k FROM m) WHERE k = 1""")
def cells_first_hit(spark, d):
    rays = spread(spark, d).select("id", g.ray(F.col("pos"), v.vec(2.0, 1.0, -2.0)).alias("ray"))
    found = cells.cells_along_rays(rays, occupied(spark, d), first_only=True)
    return found.select(F.col("ray_id").alias("id"), "x", "y", "z", F.round("distance", 7).alias("distance"))
