"""Meshes as two tables: vertices ``(vertex_id, pos, ...)`` and faces ``(face_id, v1, v2, v3, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from .spatial import running_vertex_offsets


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(id, tri)`` for each face: its vertices looked up by one join and put together again by face."""
    corners = faces.select("face_id", F.posexplode(F.array("v1", "v2", "v3")).alias("corner", "vertex_id"))
    met = corners.join(vertices.select("vertex_id", "pos"), "vertex_id")
    at = lambda k: F.max(F.when(F.col("corner") == k, F.col("pos")))
    made = met.groupBy("face_id").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), F.count("*").alias("n")).where("n = 3")
    return made.select(F.col("face_id").alias("id"), F.struct("a", "b", "c").alias("tri"))


def measures(tris: DataFrame) -> DataFrame:
    """``(id, area, normal, centroid)``; a face's area is its weight."""
    t = F.col("tri")
    return tris.select("id", g.triangle_area(t).alias("area"), g.triangle_normal(t).alias("normal"), g.triangle_centroid(t).alias("centroid"))


def merge(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meshes ``mesh_id`` in both tables, with vertices numbered from 0 in each, as one mesh.

    Vertex numbers move up by the vertices of the meshes before.
    """
    counts = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    offsets = running_vertex_offsets(counts)
    moved_vertices = vertices.join(offsets, "mesh_id").withColumn("vertex_id", F.col("vertex_id") + F.col("offset")).drop("offset")
    moved_faces = faces.join(offsets, "mesh_id")
    for k in ("v1", "v2", "v3"):
        moved_faces = moved_faces.withColumn(k, F.col(k) + F.col("offset"))
    return moved_vertices, moved_faces.drop("offset")


def unwrap(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(face_id, corner, pos, face columns...)``: three vertices of its own for each face, with the face's properties."""
    kept = [c for c in faces.columns if c not in ("v1", "v2", "v3")]
    corners = faces.select(*kept, F.posexplode(F.array("v1", "v2", "v3")).alias("corner", "vertex_id"))
    return corners.join(vertices.select("vertex_id", "pos"), "vertex_id").drop("vertex_id")


def flip(faces: DataFrame) -> DataFrame:
    """Faces turned inside out."""
    return faces.withColumns({"v2": F.col("v3"), "v3": F.col("v2")})


def box_mesh(spark: SparkSession, low: tuple, high: tuple) -> tuple[DataFrame, DataFrame]:
    """A box as 8 vertices and 12 faces that look outwards."""
    bits = F.col("id").cast("int")
    side = [F.when(bits.bitwiseAND(1 << i) != 0, float(high[i])).otherwise(float(low[i])) for i in range(3)]
    vertices = spark.range(8).select(F.col("id").alias("vertex_id"), v.vec(*side).alias("pos"))
    # the corners of a side, by the bits of x (1), y (2), z (4), as seen from outside
    sides = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    rows = [x for a, b, c, d in sides for x in ((a, b, c), (a, c, d))]
    return vertices, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "face_id long, v1 long, v2 long, v3 long")


def pose_axes(poses: DataFrame, length: float, step: float, order: str = "ts", every: int = 1) -> DataFrame:
    """``(ts, axis, pos, color)``: points along the axes of every n-th pose, X red, Y green, Z blue."""
    from .collections import every_nth

    chosen = every_nth(poses, every, [order]) if every > 1 else poses
    p = F.col("pose")
    lines = []
    for axis, rgb in zip(v.AXES, ((255, 0, 0), (0, 255, 0), (0, 0, 255))):
        points = g.ray_samples(g.ray(g.pose_position(p), g.pose_axis(p, axis)), length, step)
        colour = F.struct(*[F.lit(x).cast("short").alias(n) for x, n in zip(rgb, "rgb")])
        lines.append(F.struct(F.lit(axis).alias("axis"), points.alias("points"), colour.alias("color")))
    made = chosen.select(order, F.explode(F.array(*lines)).alias("l"))
    return made.select(order, "l.axis", F.explode("l.points").alias("pos"), "l.color")


def checkerboard(spark: SparkSession, columns: int, rows: int, square: float) -> DataFrame:
    """``(row, col, pos)``: the inner corners of a checkerboard in its own plane."""
    n = spark.range(columns * rows)
    at = n.select(F.floor(F.col("id") / columns).alias("row"), (F.col("id") % columns).alias("col"))
    return at.withColumn("pos", v.vec(F.col("col") * square, F.col("row") * square, 0.0))


def plane_grid(spark: SparkSession, width: float, height: float, step: float) -> DataFrame:
    """``(pos)``: points of a rectangle in the XY plane about the origin, edges included."""
    nx, ny = int(width / step + 1e-9) + 1, int(height / step + 1e-9) + 1
    n = spark.range(nx * ny)
    return n.select(v.vec((F.col("id") % nx) * step - width / 2, F.floor(F.col("id") / nx) * step - height / 2, 0.0).alias("pos"))


def sphere(spark: SparkSession, center: tuple, radius: float, rings: int, segments: int) -> DataFrame:
    """``(pos)``: points of a sphere by rings from pole to pole."""
    n = spark.range((rings + 1) * segments)
    polar = F.floor(F.col("id") / segments) * (3.141592653589793 / rings)
    around = (F.col("id") % segments) * (2 * 3.141592653589793 / segments)
    return n.select(v.vec(F.sin(polar) * F.cos(around) * radius + center[0], F.sin(polar) * F.sin(around) * radius + center[1], F.cos(polar) * radius + center[2]).alias("pos"))
