"""Dense grids as rows ``(x, y, z, v)``: filters, edges with hysteresis, sections, ray marching.

Stencils send each cell's share to its neighbours and add up what arrives: one shuffle each,
with sums formed before it. Cells that aren't given count as 0.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash
from .graph import connected_components

CELL = ("x", "y", "z")
#: Steps to the 26 neighbours.
NEIGHBOURS = [d for d in product((-1, 0, 1), repeat=3) if any(d)]


def extent(grid: DataFrame) -> tuple[int, int, int]:
    """Cells along each axis, from 0 to the largest index."""
    top = grid.agg(*[F.max(a) for a in CELL]).first()
    return tuple(int(t) + 1 if t is not None else 0 for t in top)


def _inside(size: tuple[int, int, int], border: int = 0) -> Column:
    found = F.lit(True)
    for a, n in zip(CELL, size):
        found = found & F.col(a).between(border, n - 1 - border)
    return found


def _spread(grid: DataFrame, weights: dict[tuple[int, int, int], list[float]], names: list[str], size: tuple[int, int, int], border: int = 0) -> DataFrame:
    """``(x, y, z, names...)``: sums of neighbours' values, weighted by their step to the cell; 0 within the border."""
    sent = [F.struct(*[(F.col(a) - d).alias(a) for a, d in zip(CELL, step)], *[(F.col("v") * w).alias(n) for w, n in zip(ws, names)]) for step, ws in weights.items()]
    summed = grid.select(F.explode(F.array(*sent)).alias("s")).select("s.*").where(_inside(size)).groupBy(*CELL).agg(*[F.sum(n).alias(n) for n in names])
    if not border:
        return summed
    return summed.select(*CELL, *[F.when(_inside(size, border), F.col(n)).otherwise(0.0).alias(n) for n in names])


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    """Weights that add up to 1; a sigma of 0 or less follows from the size."""
    if size % 2 != 1:
        raise ValueError("the kernel's size must be odd")
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def gaussian(grid: DataFrame, size: int, sigma: float, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Smoothed by a separable kernel, one axis after another; 0 outside the grid."""
    kernel, shape = gaussian_kernel(size, sigma), shape or extent(grid)
    for axis in range(3):
        if shape[axis] == 1:
            grid = grid.select(*CELL, (F.col("v") * kernel[size // 2]).alias("v"))
            continue
        steps = {tuple(i - size // 2 if a == axis else 0 for a in range(3)): [k] for i, k in enumerate(kernel)}
        grid = _spread(grid, steps, ["v"], shape)
    return grid


def sobel(grid: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``(x, y, z, gx, gy, gz)``: absolute gradients by 3x3x3 kernels; 0 on the border."""
    shape = shape or extent(grid)
    smooth = {-1: 1.0, 0: 2.0, 1: 1.0}
    weights = {}
    for step in product((-1, 0, 1), repeat=3):
        weights[step] = [step[a] * math.prod(smooth[step[b]] for b in range(3) if b != a) for a in range(3)]
    found = _spread(grid, weights, ["gx", "gy", "gz"], shape, border=1)
    return found.select(*CELL, *[F.abs(n).alias(n) for n in ("gx", "gy", "gz")])


def sobel_2d(grid: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``(x, y, z, gx, gy)`` within each plane of z, signed; outside counts as 0."""
    shape = shape or extent(grid)
    smooth = {-1: 1.0, 0: 2.0, 1: 1.0}
    weights = {(i, j, 0): [i * smooth[j], j * smooth[i]] for i, j in product((-1, 0, 1), repeat=2)}
    return _spread(grid, weights, ["gx", "gy"], shape)


def central_gradients(grid: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``(x, y, z, gx, gy, gz)``: half the difference of both neighbours; 0 on the border."""
    weights = {tuple(s if a == axis else 0 for a in range(3)): [0.5 * s if b == axis else 0.0 for b in range(3)] for axis in range(3) for s in (-1, 1)}
    return _spread(grid, weights, ["gx", "gy", "gz"], shape or extent(grid), border=1)


def suppress(gradients: DataFrame, shape: tuple[int, int, int] | None = None, as_reference: bool = False) -> DataFrame:
    """``(x, y, z, v)``: the gradient's length from those components that exceed both neighbours along their axis.

    ``as_reference``: the variant in which Y also needs Z to exceed the neighbour below it, and Z always counts.
    """
    shape = shape or extent(gradients)
    sent = [F.struct(*CELL, F.lit(None).cast("double").alias("nx"), F.lit(None).cast("double").alias("ny"), F.lit(None).cast("double").alias("nz"), F.lit(None).cast("double").alias("below"), F.col("gx").alias("gx"), F.col("gy").alias("gy"), F.col("gz").alias("gz"))]
    nothing = F.lit(None).cast("double")
    for axis in range(3):
        for s in (-1, 1):
            at = [(F.col(a) + (s if i == axis else 0)).alias(a) for i, a in enumerate(CELL)]
            near = [(F.col(f"g{b}") if i == axis else nothing).alias(f"n{b}") for i, b in enumerate(CELL)]
            below = (F.col("gz") if axis == 2 and s == 1 else nothing).alias("below")
            sent.append(F.struct(*at, *near, below, *[nothing.alias(f"g{b}") for b in CELL]))
    met = gradients.select(F.explode(F.array(*sent)).alias("s")).select("s.*").groupBy(*CELL)
    met = met.agg(*[F.max(k).alias(k) for k in ("gx", "gy", "gz")], *[F.coalesce(F.max(k), F.lit(0.0)).alias(k) for k in ("nx", "ny", "nz", "below")]).where(F.col("gx").isNotNull())
    kept = [F.when(F.col(f"g{b}") > F.col(f"n{b}"), F.col(f"g{b}")).otherwise(0.0) for b in CELL]
    if as_reference:
        kept[1] = F.when(F.col("gz") > F.col("below"), kept[1]).otherwise(0.0)
        kept[2] = F.col("gz")
    length = F.sqrt(sum((k * k for k in kept[1:]), kept[0] * kept[0]))
    return met.select(*CELL, F.when(_inside(shape, 1), length).otherwise(0.0).alias("v"))


def hysteresis(grid: DataFrame, lower: float, upper: float) -> DataFrame:
    """``(x, y, z)``: cells of ``upper`` or more, and cells of ``lower`` or more that touch them through such cells.

    Cells that touch (26 neighbours) make a graph; its components with a strong cell stay. Rounds
    grow with the logarithm of a component's diameter, not with the length of its chains.
    """
    number = F.xxhash64(*CELL)
    nodes = stash(grid.where(F.col("v") >= lower).select(*[F.col(a).cast("long").alias(a) for a in CELL], (F.col("v") >= upper).alias("strong")))
    half = [d for d in NEIGHBOURS if d > (0, 0, 0)]
    steps = F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(CELL, step)]) for step in half])
    asked = nodes.select(number.alias("a"), F.explode(steps).alias("n")).select("a", "n.*")
    edges = asked.join(nodes.select(*CELL), list(CELL), "left_semi").select("a", number.alias("b"))
    parts = connected_components(edges).withColumnRenamed("node", "_id")
    marked = nodes.withColumn("_id", number).join(parts, "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    marked = stash(marked)
    strong = marked.where("strong").select("component").distinct()
    return marked.join(strong, "component", "left_semi").select(*CELL)


def canny(grid: DataFrame, size: int, sigma: float, lower: float, upper: float) -> DataFrame:
    """``(x, y, z)``: edges of the smoothed grid."""
    shape = extent(grid)
    return hysteresis(suppress(sobel(gaussian(grid, size, sigma, shape), shape), shape), lower, upper)


def value_range(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("v").alias("low"), F.max("v").alias("high"))


def normalize(grid: DataFrame) -> DataFrame:
    """To 0..1 between the least and greatest value; 0 if they are equal."""
    ends = value_range(grid).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return grid.crossJoin(F.broadcast(ends)).select(*CELL, share.alias("v"))  # one row


def above(grid: DataFrame, threshold: float) -> DataFrame:
    """``(x, y, z)``: cells strictly above."""
    return grid.where(F.col("v") > threshold).select(*CELL)


def cross_sections(grid: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``(axis, u, w, v)``: the middle plane of each axis, at half the size rounded down."""
    shape = shape or extent(grid)
    found = None
    for i, a in enumerate(CELL):
        u, w = [b for b in CELL if b != a]
        part = grid.where(F.col(a) == shape[i] // 2).select(F.lit(a).alias("axis"), F.col(u).alias("u"), F.col(w).alias("w"), "v")
        found = part if found is None else found.unionByName(part)
    return found


def zero_crossings(plane: DataFrame) -> DataFrame:
    """``(u, w, crossing)`` of ``(u, w, v)``: whether one of eight neighbours has the other sign (0 is positive)."""
    own = F.when(F.col("v") < 0, -1).otherwise(1)
    sent = [F.struct((F.col("u") + i).alias("u"), (F.col("w") + j).alias("w"), own.alias("s"), F.lit(i == 0 and j == 0).alias("self")) for i, j in product((-1, 0, 1), repeat=2)]
    met = plane.select(F.explode(F.array(*sent)).alias("e")).select("e.*").groupBy("u", "w")
    found = met.agg(F.max(F.when(F.col("self"), F.col("s"))).alias("s"), F.min("s").alias("low"), F.max("s").alias("high")).where("s is not null")
    return found.select("u", "w", (F.col("low") != F.col("high")).alias("crossing"))


def line_of(direction: Column, cell: dict[str, Column]) -> tuple[Column, Column]:
    """For a step ``struct<dx, dy, dz>``: the lattice line a cell lies on, and its place along it."""
    d = [direction[f"d{a}"] for a in CELL]
    axis = F.when(d[0] != 0, F.lit(0)).when(d[1] != 0, F.lit(1)).otherwise(F.lit(2))
    pick = lambda xs: F.when(axis == 0, xs[0]).when(axis == 1, xs[1]).otherwise(xs[2])
    lead, sign = pick([cell[a] for a in CELL]), pick(d)
    place = lead * sign
    line = F.struct(*[(cell[a] - d[i] * place).alias(a) for i, a in enumerate(CELL)])
    return line, place


def march(entries: DataFrame, occupied: DataFrame) -> DataFrame:
    """``(x, y, z)``: the first occupied cells that rays meet.

    ``entries``: ``(x, y, z, dx, dy, dz)``, cells with one of 26 directions; those that are occupied
    themselves are left out. A diagonal step ends without a hit if all the cells beside it (one
    axis of the step each) are occupied.

    A ray runs along a lattice line, so its hit is the next occupied cell on that line: one
    shuffle by line and one ordered pass, whatever the distance.
    """
    taken = occupied.select(*[F.col(a).cast("long").alias(a) for a in CELL]).distinct()
    taken = stash(taken)
    starts = entries.select(*[F.col(k).cast("long").alias(k) for k in (*CELL, "dx", "dy", "dz")]).distinct().join(taken, list(CELL), "left_anti")
    starts = stash(starts)
    used = starts.select(F.struct("dx", "dy", "dz").alias("d")).distinct()  # 26 at most
    sides = taken.crossJoin(F.broadcast(used)).select(*CELL, "d")
    line, place = line_of(F.col("d"), {a: F.col(a) for a in CELL})
    s_line, s_place = line_of(F.struct("dx", "dy", "dz"), {a: F.col(a) for a in CELL})
    both = sides.select("d", line.alias("line"), place.alias("place"), F.struct(*CELL).alias("hit"), F.lit(False).alias("ray")).unionByName(
        starts.select(F.struct("dx", "dy", "dz").alias("d"), s_line.alias("line"), s_place.alias("place"), F.lit(None).cast("struct<x:long,y:long,z:long>").alias("hit"), F.lit(True).alias("ray"))
    )
    ahead = Window.partitionBy("d", "line").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    hits = both.withColumn("next", F.first("hit", ignorenulls=True).over(ahead)).where("ray and next is not null").select("d", "next.*").distinct()
    hits = stash(hits)
    beside = F.filter(F.array(*[F.struct(*[(F.col(b) - F.col(f"d.d{b}") + (F.col(f"d.d{b}") if b == a else F.lit(0))).alias(f"s{b}") for b in CELL], (F.col(f"d.d{a}") != 0).alias("asked")) for a in CELL]), lambda s: s["asked"])
    looked = hits.withColumn("_n", F.size(beside)).withColumn("s", F.explode(beside)).where("_n > 1")
    full = looked.join(taken.select(*[F.col(a).alias(f"_{a}") for a in CELL]), F.expr("s.sx = _x and s.sy = _y and s.sz = _z")).groupBy("d", *CELL, "_n").agg(F.count("*").alias("m")).where("m = _n")
    return hits.join(full.select("d", *CELL), ["d", *CELL], "left_anti").select(*CELL).distinct()


def to_world(cells: DataFrame, resolution: float, low: tuple[float, float, float]) -> DataFrame:
    """``cells`` with ``pos``, the middle of each."""
    middle = [((F.col(a) + 0.5) * resolution + o).alias(a) for a, o in zip(CELL, low)]
    return cells.withColumn("pos", F.struct(*middle))


def from_crop(cells: DataFrame, orientation: Column, center: tuple[float, float, float]) -> DataFrame:
    """``cells`` with ``pos`` turned out of a crop's frame, about its centre."""
    from ..functions import vectors as v

    return cells.withColumn("pos", v.rotate(F.col("pos"), orientation, v.vec(*[F.lit(float(x)) for x in center])))


def slices(grid: DataFrame, axis: str) -> DataFrame:
    """``(slice, r, c, v)``: the grid as images at right angles to an axis, one for each of its indices."""
    r, c = [a for a in CELL if a != axis]
    return grid.select(F.col(axis).alias("slice"), F.col(r).alias("r"), F.col(c).alias("c"), "v")


def to_cell(p: Column, resolution: float) -> Column:
    """``struct<x, y, z>``: the nearest cell, ``trunc(p / resolution + 0.5)``."""
    return F.struct(*[(p[a] / resolution + 0.5).cast("long").alias(a) for a in CELL])
