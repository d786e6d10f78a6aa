"""Scalar functions on numbers, angles, durations, colours, arrays, property bags, vectors and poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..functions import vectors as v
from ..registry import query, table

# The wrap of an angle's difference, as SQL.
WRAP = "CASE WHEN abs(CASE WHEN a < b THEN a - b + {c} ELSE a - b - {c} END) < abs(a - b) THEN CASE WHEN a < b THEN a - b + {c} ELSE a - b - {c} END ELSE a - b END"


@query("angle_diff", f"""
WITH e AS (SELECT event_id, value % 360 AS a, CAST(event_id * 37 % 360 AS DOUBLE) AS b FROM events)
SELECT event_id, round({WRAP.format(c="360")}, 8) AS degrees, round(radians(a), 8) AS a_radians FROM e""")
def angle_diff(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") % 360).alias("a"), (F.col("event_id") * 37 % 360).cast("double").alias("b"))
    return e.select("event_id", F.round(s.angle_difference_degrees("a", "b"), 8).alias("degrees"), F.round(F.radians("a"), 8).alias("a_radians"))


@query("angle_diff_radians", f"""
WITH e AS (SELECT event_id, value % 6 AS a, CAST(event_id % 63 AS DOUBLE) / 10 AS b FROM events)
SELECT event_id, round({WRAP.format(c="2 * pi()")}, 8) AS radians, round(degrees(a), 6) AS a_degrees FROM e""")
def angle_diff_radians(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") % 6).alias("a"), ((F.col("event_id") % 63).cast("double") / 10).alias("b"))
    return e.select("event_id", F.round(s.angle_difference("a", "b"), 8).alias("radians"), F.round(F.degrees("a"), 6).alias("a_degrees"))


@query("duration_fmt", """
WITH e AS (SELECT event_id, event_id * 98765 AS ms FROM events),
p AS (SELECT *, ms // 86400000 AS d, ms % 86400000 // 3600000 AS h, ms % 3600000 // 60000 AS m, ms % 60000 // 1000 AS s FROM e)
SELECT event_id, CASE WHEN d > 0 THEN d || 'd/' ELSE '' END || CASE WHEN h > 0 THEN h || 'h/' ELSE '' END || CASE WHEN m > 0 THEN m || 'm/' ELSE '' END
    || CASE WHEN s > 0 THEN s || 's/' ELSE '' END || ms % 1000 || 'ms' AS duration FROM p""")
def duration_fmt(spark, d):
    return table(spark, d, "events").select("event_id", s.format_milliseconds(F.col("event_id") * 98765).alias("duration"))


@query("timestamp_string", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def timestamp_string(spark, d):
    return table(spark, d, "events").select("event_id", s.timestamp_string("ts").alias("stamp"))


@query("numbers", """
SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS even, CAST(trunc(-o_totalprice / 7) AS BIGINT) AS cut, CAST(length(CAST(o_custkey AS VARCHAR)) AS INTEGER) AS digits,
    printf('%.2f', o_totalprice) AS fixed, (o_totalprice - 250000 < 0) = (o_custkey - 500 < 0) AS same, abs(o_totalprice - 250000) < 50000 AS near,
    round(0.25 * o_totalprice + 0.75 * o_custkey, 4) AS blend, round(log10(o_totalprice), 8) AS log10, round(sqrt(o_totalprice), 8) AS sqrt FROM orders""")
def numbers(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", s.round_even(p / 1000).alias("even"), s.truncate(-p / 7).alias("cut"), s.digit_count(k).alias("digits"), s.fixed(p, 2).alias("fixed"),
        s.same_sign(p - 250000, k - 500).alias("same"), s.approx_equal(p, F.lit(250000.0), 50000).alias("near"), F.round(s.blend(p, k, 0.25), 4).alias("blend"),
        F.round(F.log10(p), 8).alias("log10"), F.round(F.sqrt(p), 8).alias("sqrt"),
    )


@query("to_8bit", """
SELECT event_id, CAST(CASE WHEN value < 10 THEN 0 WHEN value > 200 THEN 255 ELSE floor(value * 254.0 / 190.0 + 1 - 254.0 * 10.0 / 190.0) END AS INTEGER) AS grey FROM events""")
def to_8bit(spark, d):
    return table(spark, d, "events").select("event_id", s.to_8bit("value", 10.0, 200.0).alias("grey"))


def _colors(spark, d):
    rgb = s.color(F.col("p_size") * 5, F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256)
    return table(spark, d, "part").select("p_partkey", rgb.alias("a"), s.color(F.lit(100), F.col("p_size"), F.lit(200)).alias("b"))


COLORS = "c AS (SELECT p_partkey, least(p_size * 5, 255) AS r, p_partkey % 256 AS g, p_partkey * 7 % 256 AS b, p_size FROM part)"


@query("color_hsv", f"""
WITH {COLORS}, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN r = hi THEN (g - b) / (hi - lo) WHEN g = hi THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END * 60.0 AS h FROM m)
SELECT p_partkey, round(CAST(CASE WHEN hi = 0 THEN -1 WHEN h < 0 THEN h + 360 ELSE h END AS DOUBLE), 8) AS h, round(CAST(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS DOUBLE), 8) AS s,
    CAST(CASE WHEN hi = 0 THEN -1 ELSE hi END AS DOUBLE) AS v FROM h""")
def color_hsv(spark, d):
    found = _colors(spark, d).select("p_partkey", s.rgb_to_hsv(F.col("a")).alias("x"))
    return found.select("p_partkey", F.round("x.h", 8).alias("h"), F.round("x.s", 8).alias("s"), "x.v")


@query("color_add", f"""
WITH {COLORS} SELECT p_partkey, CAST(least(r + 100, 255) AS INTEGER) AS r, CAST(least(g + p_size, 255) AS INTEGER) AS g, CAST(trunc(b * 0.5) AS INTEGER) AS half_b,
    abs(r - 100) <= 60 AND abs(g - p_size) <= 60 AND abs(b - 200) <= 60 AS near, CAST(round_even(0.299 * r + 0.587 * g + 0.114 * b, 0) AS INTEGER) AS grey FROM c""")
def color_add(spark, d):
    a, b = F.col("a"), F.col("b")
    total = s.color_add(a, b)
    return _colors(spark, d).select(
        "p_partkey", total["r"].cast("int").alias("r"), total["g"].cast("int").alias("g"), s.color_scale(a, 0.5)["b"].cast("int").alias("half_b"),
        s.colors_equal(a, b, 60).alias("near"), s.grey(a).alias("grey"),
    )


@query("arrays", """
SELECT vec_id, len([x FOR x IN embedding IF abs(CAST(x AS DOUBLE) - 0.1) < 0.002]) > 0 AS holds, CAST(len(embedding[1:64:5]) AS INTEGER) AS fifths,
    len(list_distinct(embedding)) = len(embedding) AS distinct_ FROM embeddings""")
def arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", s.approx_contains(e.cast("array<double>"), 0.1, 0.002).alias("holds"), F.size(s.every_nth_of(e, 5)).alias("fifths"), s.all_distinct(e).alias("distinct_"))


@query("properties", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.missing') IS NOT NULL AS has, CAST(user_id AS INTEGER) AS user,
    CAST(coalesce(CAST(json_extract(props, '$.other') AS INTEGER), -1) AS INTEGER) AS other, 'k,user' AS names FROM events""")
def properties(spark, d):
    bag = s.set_properties(F.from_json("props", "map<string,int>"), F.create_map(F.lit("user"), F.col("user_id").cast("int")))
    e = table(spark, d, "events").withColumn("bag", bag)
    b = F.col("bag")
    return e.select(
        "event_id", s.get_property(b, "k").alias("k"), s.has_property(b, "missing").alias("has"), s.get_property(b, "user").alias("user"),
        s.get_property(b, "other", -1).alias("other"), F.array_join(s.property_names(b), ",").alias("names"),
    )


E = "e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az, CAST(embedding[4] AS DOUBLE) AS bx, CAST(embedding[5] AS DOUBLE) AS b_y, CAST(embedding[6] AS DOUBLE) AS bz FROM embeddings)"


def _pairs(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", v.vec(at(0), at(1), at(2)).alias("a"), v.vec(at(3), at(4), at(5)).alias("b"))


@query("vector_ops", f"""
WITH {E}, n AS (SELECT *, ax * bx + ay * b_y + az * bz AS d, sqrt(ax * ax + ay * ay + az * az) AS na, sqrt(bx * bx + b_y * b_y + bz * bz) AS nb FROM e)
SELECT vec_id, round(na, 8) AS norm, round(d, 8) AS dot, round(acos(greatest(-1, least(1, d / (na * nb)))), 7) AS angle, round(ay * bz - az * b_y, 8) AS cross_x,
    round(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2 + (az - bz) ** 2), 8) AS distance, round(ax / na, 8) AS unit_x, round(greatest(ax, ay, az), 8) AS largest,
    round(ax - d / (nb * nb) * bx, 8) AS rest_x, round(ax * b_y, 8) AS outer_01, (ax < 0) = (bx < 0) AND (ay < 0) = (b_y < 0) AND (az < 0) = (bz < 0) AS same FROM n""")
def vector_ops(spark, d):
    a, b = F.col("a"), F.col("b")
    r = lambda x, n=8: F.round(x, n)
    return _pairs(spark, d).select(
        "vec_id", r(v.norm(a)).alias("norm"), r(v.dot(a, b)).alias("dot"), r(v.angle(a, b), 7).alias("angle"), r(v.cross(a, b)["x"]).alias("cross_x"), r(v.distance(a, b)).alias("distance"),
        r(v.unit(a)["x"]).alias("unit_x"), r(v.largest(a)).alias("largest"), r(v.project_orthogonal(a, v.unit(b))["x"]).alias("rest_x"), r(v.at(v.outer(a, b), 0, 1)).alias("outer_01"), v.same_sign(a, b).alias("same"),
    )


@query("rotations", f"""
WITH {E}, q AS (SELECT *, sqrt(ax * ax + ay * ay + az * az + 0.25) AS n FROM e), u AS (SELECT *, ax / n AS x, ay / n AS y, az / n AS z, 0.5 / n AS w FROM q),
m AS (SELECT *, 1 - 2 * (y * y + z * z) AS m00, 2 * (x * y + z * w) AS m10, 2 * (x * z - y * w) AS m20, 2 * (y * z + x * w) AS m21, 1 - 2 * (x * x + y * y) AS m22,
    2 * (x * y - z * w) AS m01, 2 * (x * z + y * w) AS m02 FROM u)
SELECT vec_id, round(m00 * bx + m01 * b_y + m02 * bz, 8) AS turned_x, round(atan2(m21, m22), 7) AS euler_x, round(atan2(-m20, sqrt(m21 * m21 + m22 * m22)), 7) AS euler_y,
    round(atan2(m10, m00), 7) AS euler_z, true AS rigid, round(2 * acos(w) * x / sqrt(1 - w * w), 6) AS axis_angle_x, round(w, 7) AS w FROM m""")
def rotations(spark, d):
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    q = F.struct(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z"), F.lit(0.5).alias("w"))
    e = _pairs(spark, d).withColumn("m", v.quaternion_to_matrix(q))
    euler = v.euler_from_matrix(m)
    return e.select(
        "vec_id", F.round(v.mat_vec(m, b)["x"], 8).alias("turned_x"), *[F.round(euler[x], 7).alias(f"euler_{x}") for x in v.AXES], v.is_rotation(m).alias("rigid"),
        F.round(v.rodrigues_from_matrix(m)["x"], 6).alias("axis_angle_x"), F.round(v.matrix_to_quaternion(m)["w"], 7).alias("w"),
    )


@query("pose_chain", f"""
WITH {E}, t AS (SELECT *, cos(ax) AS c, sin(ax) AS s FROM e), f AS (SELECT *, c * ay - s * az + bx AS px, s * ay + c * az + b_y AS py FROM t)
SELECT vec_id, round(px, 8) AS x, round(py, 8) AS y, round(bz + 1, 8) AS z, round(ay, 8) AS back_x, round(az, 8) AS back_y, true AS rigid FROM f""")
def pose_chain(spark, d):
    a, b = F.col("a"), F.col("b")
    e = _pairs(spark, d).withColumn("pose", g.pose(v.rotation_z(a["x"]), b)).withColumn("p", v.vec(a["y"], a["z"], 1.0))
    e = e.withColumn("moved", g.pose_apply(F.col("pose"), F.col("p"))).withColumn("both", g.pose_mul(g.pose_inverse(F.col("pose")), F.col("pose")))
    back = g.pose_apply(g.pose_inverse(F.col("pose")), F.col("moved"))
    return e.select(
        "vec_id", *[F.round(F.col("moved")[k], 8).alias(k) for k in v.AXES], F.round(back["x"], 8).alias("back_x"), F.round(back["y"], 8).alias("back_y"),
        (g.pose_is_rigid(F.col("pose")) & v.is_identity(g.pose_rotation(F.col("both")))).alias("rigid"),
    )


@query("projection", f"""
WITH {E}, p AS (SELECT *, ax / (az + 1) AS u, ay / (az + 1) AS w FROM e), q AS (SELECT *, 1 + 0.1 * (u * u + w * w) AS k FROM p),
r AS (SELECT *, 100 * u * k + 32 AS x, 100 * w * k + 24 AS y FROM q)
SELECT vec_id, round(CASE WHEN x >= 0 AND y >= 0 AND x < 64 AND y < 48 THEN x ELSE -1 END, 7) AS x, round(CASE WHEN x >= 0 AND y >= 0 AND x < 64 AND y < 48 THEN y ELSE -1 END, 7) AS y,
    round((5 - 32) / 100.0 * (bx + 1), 8) AS back_x FROM r""")
def projection(spark, d):
    camera = F.struct(F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(32.0).alias("cx"), F.lit(24.0).alias("cy"))
    a, b = F.col("a"), F.col("b")
    seen = g.project(v.vec(a["x"], a["y"], a["z"] + 1), camera, 48, 64, k1=0.1)
    back = g.back_project(F.lit(3), F.lit(5), b["x"] + 1, camera)
    return _pairs(spark, d).select("vec_id", F.round(seen["x"], 7).alias("x"), F.round(seen["y"], 7).alias("y"), F.round(back["x"], 8).alias("back_x"))


@query("plane_and_triangle", f"""
WITH {E}, t AS (SELECT *, b_y * 1 AS cx, bz AS cy FROM e)
SELECT vec_id, round(abs((ax + ay + az - 0.3) / sqrt(3)), 8) AS plane_distance, round(abs(0.5 * (bx * cy - b_y * cx)), 8) AS area,
    CASE WHEN (0 - az) / 1.0 >= -1e-12 THEN round(-az, 8) END AS hit, round((0 + bx + cx) / 3, 8) AS centroid_x FROM t""")
def plane_and_triangle(spark, d):
    a, b = F.col("a"), F.col("b")
    p = g.plane(v.vec(0.1, 0.1, 0.1), v.vec(1.0, 1.0, 1.0))
    t = g.triangle(v.vec(0.0, 0.0, 0.0), v.vec(b["x"], b["y"], 0.0), v.vec(b["y"], b["z"], 0.0))
    up = g.ray(a, v.vec(0.0, 0.0, 2.0))
    ground = g.plane(v.vec(0.0, 0.0, 0.0), v.vec(0.0, 0.0, 1.0))
    return _pairs(spark, d).select(
        "vec_id", F.round(g.plane_distance(p, a), 8).alias("plane_distance"), F.round(g.triangle_area(t), 8).alias("area"), F.round(g.ray_plane(up, ground), 8).alias("hit"), F.round(g.triangle_centroid(t)["x"], 8).alias("centroid_x"),
    )


@query("line_samples", """
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(i * 2.5, 6) AS x FROM (SELECT p_partkey, unnest(generate_series(0, CAST(floor(p_size / 2.5) AS INTEGER))) AS i FROM part WHERE p_size > 0)""")
def line_samples(spark, d):
    line = g.segment_samples(v.vec(0.0, 0.0, 0.0), v.vec(F.col("p_size"), 0.0, 0.0), 2.5)
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.posexplode(line).alias("i", "pos")).select("p_partkey", "i", F.round("pos.x", 6).alias("x"))


@query("projection_radial", f"""
WITH {E}, p AS (SELECT *, ax / (az + 1) AS u, ay / (az + 1) AS w FROM e)
SELECT vec_id, CASE WHEN az + 1 > 0 THEN round(90 * (1 - 0.2 * (u * u + w * w)) * u + 30, 7) END AS x, CASE WHEN az + 1 > 0 THEN round(90 * (1 - 0.2 * (u * u + w * w)) * w + 20, 7) END AS y FROM p""")
def projection_radial(spark, d):
    a = F.col("a")
    seen = g.project_radial(v.vec(a["x"], a["y"], a["z"] + 1), F.lit(90.0), F.lit(30.0), F.lit(20.0), F.lit(-0.2))
    return _pairs(spark, d).select("vec_id", F.round(seen["x"], 7).alias("x"), F.round(seen["y"], 7).alias("y"))


@query("ray_rectangle", f"""
WITH {E} SELECT vec_id, CASE WHEN ax BETWEEN -0.1 AND 0.2 AND ay BETWEEN -0.2 AND 0.1 AND az <= 1.5 THEN round(1.5 - az, 8) END AS distance FROM e""")
def ray_rectangle(spark, d):
    a = F.col("a")
    wall = g.rectangle_box("z", F.lit(0.5), -0.1, -0.2, 0.2, 0.1)
    ray = g.ray(v.vec(a["x"], a["y"], a["z"] - 1), v.vec(0.0, 0.0, 1.0))
    return _pairs(spark, d).select("vec_id", F.round(F.get(g.ray_box_hits(ray, wall), F.lit(0)), 8).alias("distance"))


@query("pose_sequence", f"""
WITH {E}, s AS (SELECT vec_id, ax * cos(0.5) - ay * sin(0.5) + 1 AS x, ax * sin(0.5) + ay * cos(0.5) AS y, az AS z FROM e)
SELECT vec_id, round(x * cos(0.25) - y * sin(0.25), 8) AS x, round(x * sin(0.25) + y * cos(0.25) + 2, 8) AS y, round(z, 8) AS z FROM s""")
def pose_sequence(spark, d):
    steps = F.array(g.pose(v.rotation_z(0.5), v.vec(1.0, 0.0, 0.0)), g.pose(v.rotation_z(0.25), v.vec(0.0, 2.0, 0.0)))
    moved = g.pose_apply(g.chain(steps), F.col("a"))
    return _pairs(spark, d).select("vec_id", *[F.round(moved[k], 8).alias(k) for k in "xyz"])
