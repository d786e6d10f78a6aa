"""Searches over the occupied cells of a grid: nearest, within boxes, along rays.

Cells are rows ``(x, y, z)`` of whole numbers; a cell is the closed cube of edge ``resolution`` about
``low + resolution * (x, y, z)``. These are the joins of :mod:`.spatial` with the cells' cubes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from . import spatial

CELL = ("x", "y", "z")


def cubes(cells: DataFrame, resolution: float = 1.0, low: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``(id, center, box)`` of each cell once, its id being its coordinates."""
    at = F.struct(*[F.col(a).cast("long").alias(a) for a in CELL]).alias("id")
    middle = v.vec(*[F.col(f"id.{a}") * float(resolution) + float(o) for a, o in zip(CELL, low)])
    found = cells.select(at).distinct().withColumn("center", middle)
    return found.withColumn("box", g.box_from_center(F.col("center"), v.vec(*[float(resolution)] * 3)))


def nearest_cells(points: DataFrame, cells: DataFrame, resolution: float = 1.0, low: tuple[float, float, float] = (0.0, 0.0, 0.0), max_distance: float | None = None) -> DataFrame:
    """``(point_id, x, y, z, distance)``: the cell whose cube is nearest to each point ``(id, pos)``, of equal ones
    the first by coordinates; 0 inside. ``max_distance`` is closed.

    The nearest centre bounds the distance; a centre within that and a cube's half diagonal is then tried exactly.
    """
    half = resolution * math.sqrt(3) / 2
    filed = cubes(cells, resolution, low)
    reach = None if max_distance is None else max_distance + half
    bound = spatial.nearest(points, filed.select("id", F.col("center").alias("pos")), reach).select("query_id", F.col("distance").alias("bound"))
    asked = points.select(F.col("id").alias("query_id"), "pos").join(bound, "query_id")
    around = lambda d: g.box(v.each(lambda x: x - d, F.col("pos")), v.each(lambda x: x + d, F.col("pos")))
    searched = asked.select("query_id", F.struct("query_id", "pos").alias("id"), around(F.col("bound") + half * (1 + 1e-9)).alias("box"))
    pairs = spatial.points_in_boxes(filed.select("id", F.col("center").alias("pos")), searched.select("id", "box"))
    full = pairs.select("box_id.query_id", "box_id.pos", F.col("point_id").alias("id")).withColumn("center", v.vec(*[F.col(f"id.{a}") * float(resolution) + float(o) for a, o in zip(CELL, low)]))
    gap = g.box_distance(g.box_from_center(F.col("center"), v.vec(*[float(resolution)] * 3)), F.col("pos"))
    near = full.withColumn("distance", gap)
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    best = near.groupBy("query_id").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select(F.col("query_id").alias("point_id"), "b.id.*", "b.distance")


def cells_in_boxes(boxes: DataFrame, cells: DataFrame, resolution: float = 1.0, low: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``(box_id, x, y, z)``: the cells whose cubes meet each box ``(id, box)``; a common face counts."""
    pairs = spatial.boxes_meeting(boxes, cubes(cells, resolution, low).select("id", "box"))
    return pairs.select(F.col("a_id").alias("box_id"), "b_id.*")


def cells_along_rays(rays: DataFrame, cells: DataFrame, resolution: float = 1.0, low: tuple[float, float, float] = (0.0, 0.0, 0.0), first_only: bool = False) -> DataFrame:
    """``(ray_id, x, y, z, distance)``: the occupied cells that rays ``(id, ray)`` meet, or the first of each."""
    met = spatial.rays_through_boxes(rays, cubes(cells, resolution, low).select("id", "box"), float(resolution), first_only)
    return met.select("ray_id", "box_id.*", "distance")
