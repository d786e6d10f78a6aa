"""Voxels: grouping geometries by the closed cubes of a grid.

Cubes are centred on ``offset + index * resolution``; the offset lies one cube below the least
position. A point on a face of cubes belongs to each of them, on a corner to eight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v

INDEX = ("vx", "vy", "vz")


def offset_of(rows: DataFrame, resolution: float, position: str = "pos") -> tuple[float, float, float] | None:
    """The grid's offset: the least position less one cube; None without rows."""
    p = F.col(position)
    low = rows.agg(*[F.min(p[a]) for a in v.AXES]).first()
    return None if low[0] is None else tuple(x - resolution for x in low)


def grid_size(rows: DataFrame, resolution: float, position: str = "pos") -> DataFrame:
    """One row ``(nx, ny, nz)``: cubes along each axis, with one to spare on both ends, at least 1."""
    p = F.col(position)
    return rows.agg(*[F.greatest(F.ceil((F.max(p[a]) - F.min(p[a]) + 2 * resolution) / resolution), F.lit(1)).alias(f"n{a}") for a in v.AXES])


def indices(p: Column, resolution: float, offset: tuple[float, float, float]) -> Column:
    """``array<struct<vx, vy, vz>>``: the one to eight cubes that hold a point."""
    runs = []
    for a, o in zip(v.AXES, offset):
        u = (p[a] - F.lit(float(o))) / F.lit(float(resolution))
        runs.append(F.sequence(F.ceil(u - 0.5), F.floor(u + 0.5)))
    make = lambda i: lambda j: lambda k: F.struct(i.alias("vx"), j.alias("vy"), k.alias("vz"))
    return F.flatten(F.transform(runs[0], lambda i: F.flatten(F.transform(runs[1], lambda j: F.transform(runs[2], make(i)(j))))))


def voxelize(rows: DataFrame, resolution: float, offset: tuple[float, float, float] | None = None, position: str = "pos") -> DataFrame:
    """``rows`` with ``vx, vy, vz``: a row for each cube that holds the position."""
    offset = offset or offset_of(rows, resolution, position) or (0.0, 0.0, 0.0)
    held = rows.where(F.col(position).isNotNull())
    return held.select("*", F.explode(indices(F.col(position), resolution, offset)).alias("_v")).select(*rows.columns, "_v.*")


def voxel_box(resolution: float, offset: tuple[float, float, float]) -> Column:
    center = v.vec(*[F.col(i) * resolution + o for i, o in zip(INDEX, offset)])
    return g.box_from_center(center, v.vec(*[float(resolution)] * 3))


def voxelize_triangles(triangles: DataFrame, resolution: float, offset: tuple[float, float, float]) -> DataFrame:
    """``triangles`` (``id, tri``) with ``vx, vy, vz``: a row for each cube that the triangle meets."""
    b = g.triangle_box(F.col("tri"))
    runs = []
    for a, o in zip(v.AXES, offset):
        low, high = (b["min"][a] - o) / resolution, (b["max"][a] - o) / resolution
        runs.append(F.sequence(F.ceil(low - 0.5), F.floor(high + 0.5)))
    found = triangles
    for i, r in zip(INDEX, runs):
        found = found.withColumn(i, F.explode(r))
    return found.where(g.triangle_hits_box(F.col("tri"), voxel_box(resolution, offset)))


def occupancy(rows: DataFrame, resolution: float, offset: tuple[float, float, float] | None = None, position: str = "pos") -> DataFrame:
    """``(vx, vy, vz, n)``: the cubes that hold something, and how much."""
    return voxelize(rows, resolution, offset, position).groupBy(*INDEX).agg(F.count("*").alias("n"))


def subsample(
    rows: DataFrame, resolution: float, least: int = 1, properties: dict[str, Column] | None = None, offset: tuple[float, float, float] | None = None, position: str = "pos",
) -> DataFrame:
    """``(vx, vy, vz, n, pos, ...)``: the mean position of each cube with ``least`` rows or more.

    ``properties``: names and aggregates to compute beside it.
    """
    p = F.col(position)
    mean = F.struct(*[F.avg(p[a]).alias(a) for a in v.AXES]).alias("pos")
    more = [a.alias(n) for n, a in (properties or {}).items()]
    return voxelize(rows, resolution, offset, position).groupBy(*INDEX).agg(F.count("*").alias("n"), mean, *more).where(F.col("n") >= least)


def apply(rows: DataFrame, resolution: float, f: Callable, schema: str, offset: tuple[float, float, float] | None = None, position: str = "pos") -> DataFrame:
    """A function of each cube's rows as a pandas frame; where an aggregate does, use :func:`subsample`."""
    return voxelize(rows, resolution, offset, position).groupBy(*INDEX).applyInPandas(f, schema)
