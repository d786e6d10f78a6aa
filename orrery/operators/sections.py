"""Cross sections of meshes: the cells of middle planes that triangles meet, and outlines as ordered polylines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..storage import discard, stash
from .graph import connected_components
from .voxel import INDEX, voxel_box


def section_cells(triangles: DataFrame, resolution: float, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """``(axis, u, w)``: the cells of each axis's middle plane that some of the ``triangles`` (id, tri) meets, as indices along the other axes.

    The grid has a cell centred at ``low`` and reaches to ``high`` or beyond; the middle is half its size, rounded down. Only triangles whose box meets
    the plane's cells are cut into cells, and only into those.
    """
    shape = [math.ceil((h - o) / resolution) + 1 for o, h in zip(low, high)]
    t = F.col("tri")
    found = None
    for i, axis in enumerate(v.AXES):
        rows = triangles.where("tri is not null").select("tri")
        for k, (a, o, n) in enumerate(zip(v.AXES, low, shape)):
            ends = [f(*[t[c][a] for c in "abc"]) for f in (F.least, F.greatest)]
            first, last = F.ceil((ends[0] - o) / resolution - 0.5), F.floor((ends[1] - o) / resolution + 0.5)
            inner = [F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))]
            if k == i:
                inner = [F.greatest(inner[0], F.lit(n // 2)), F.least(inner[1], F.lit(n // 2))]
            rows = rows.withColumn(INDEX[k], F.explode(F.when(inner[0] <= inner[1], F.sequence(*inner))))
        met = rows.where(g.triangle_hits_box(t, voxel_box(resolution, low)))
        u, w = [x for k, x in enumerate(INDEX) if k != i]
        part = met.select(F.lit(axis).alias("axis"), F.col(u).alias("u"), F.col(w).alias("w")).distinct()
        found = part if found is None else found.unionByName(part)
    return found


def _crossing(p: Column, q: Column, axis: str, at: float) -> Column:
    """The point of an edge in the plane, computed from its lesser end, so that both triangles of an edge have the same one."""
    a, b = F.least(p, q), F.greatest(p, q)
    share = (F.lit(float(at)) - a[axis]) / (b[axis] - a[axis])
    return v.vec(*[a[k] + (b[k] - a[k]) * share if k != axis else F.lit(float(at)) for k in v.AXES])


def section_lines(triangles: DataFrame, axis: str, at: float) -> DataFrame:
    """``(id, start, end)``: the line in which each triangle (id, tri) crosses the plane ``axis`` = ``at``.

    It runs from the edge that rises through the plane, in the triangle's sense of rotation, to the one that falls, so the lines of triangles
    of one sense follow each other. Corners in the plane count as above it; triangles that lie above or only touch have none.
    """
    t = F.col("tri")
    above = {c: t[c][axis] >= at for c in "abc"}
    edges = ("ab", "bc", "ca")
    pick = lambda rising: F.coalesce(*[F.when((~above[p] & above[q]) if rising else (above[p] & ~above[q]), _crossing(t[p], t[q], axis, at)) for p, q in edges])
    some = (above["a"] != above["b"]) | (above["b"] != above["c"])
    rows = triangles.where("tri is not null").where(some)
    return rows.select("id", pick(True).alias("start"), pick(False).alias("end"))


def chained(lines: DataFrame, digits: int = 9) -> DataFrame:
    """``lines`` (id, start, end) with ``line`` and ``ord``: the polyline each belongs to, by its least id, and its place in there.

    A line follows the one that ends where it starts, to so many digits; of several, the one of least id, which it only follows if it
    is that one's first follower, too, so the rest begin polylines of their own. A polyline begins at the line without a predecessor, a ring (``closed``) at its least id. Places are found by
    doubling: in each round a line takes the way of the one it has reached so far, so rounds grow with the logarithm of the longest polyline.
    """
    key = lambda c: F.struct(*[(F.round(F.col(c)[a], digits) + 0.0).alias(a) for a in v.AXES])
    rows = stash(lines.select("id", key("start").alias("_s"), key("end").alias("_e")))
    before = rows.select(F.col("_e").alias("_s"), F.col("id").alias("prev")).groupBy("_s").agg(F.min("prev").alias("prev"))
    first = rows.groupBy("_s").agg(F.min("id").alias("id"))
    links = stash(first.join(before, "_s").select("id", "prev").where("id <> prev"))
    parts = connected_components(links, "id", "prev").withColumnRenamed("node", "id")
    nodes = rows.select("id").join(parts, "id", "left").join(links, "id", "left").select("id", F.coalesce("component", "id").alias("line"), "prev")
    nodes = stash(nodes)
    heads = nodes.groupBy("line").agg(F.max(F.col("prev").isNull()).alias("_open"))
    ways = nodes.join(heads, "line").withColumn("prev", F.when(F.col("_open") | (F.col("id") != F.col("line")), F.col("prev")))
    ways = stash(ways.select("id", "line", (~F.col("_open")).alias("closed"), "prev", F.col("prev").isNotNull().cast("long").alias("ord")))
    while not ways.where("prev is not null").isEmpty():
        reached = ways.select(F.col("id").alias("prev"), F.col("prev").alias("_next"), F.col("ord").alias("_far"))
        further = stash(ways.join(reached, "prev", "left").select("id", "line", "closed", F.col("_next").alias("prev"), (F.col("ord") + F.coalesce("_far", F.lit(0).cast("long"))).alias("ord")))
        discard(ways)
        ways = further
    return lines.join(ways.select("id", "line", "ord", "closed"), "id")
