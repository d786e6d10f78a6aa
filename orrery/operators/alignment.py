"""The main directions of a scene: an upright axis and a level one, from weighted normals.

Normals are counted in bins of one degree, so only these sums, of which there are at most some
ten thousand, reach the driver; the peak is then refined over all normals near it. Rows are
``(normal, weight)``, a unit vector and a number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..storage import stash
from .graph import connected_components

#: Degrees about a peak from which its direction is refined, and how often.
NEAR, ROUNDS = 5.0, 3
#: Most degrees between the upright axis and where it is looked for.
TILT = 45


def constant(xyz: tuple[float, float, float]) -> Column:
    return v.vec(*[F.lit(float(x)) for x in xyz])


def level_pair(up: tuple[float, float, float], towards: tuple[float, float, float]) -> tuple[tuple, tuple]:
    """Two directions at right angles to ``up`` and each other; the first lies towards a given one."""
    import numpy as np

    u, t = np.array(up, float) / np.linalg.norm(up), np.array(towards, float)
    first = t - u * (t @ u)
    if np.linalg.norm(first) < 1e-9:
        raise ValueError("the level direction must not be the upright one")
    first /= np.linalg.norm(first)
    return tuple(first), tuple(np.cross(u, first))


def orientation(normal: Column, up: tuple, level: tuple) -> Column:
    """``struct<azimuth, tilt>`` in degrees: of a normal turned to the side of ``up``, 0 to 360 about it and 0 to 90 from it."""
    first, second = level_pair(up, level)
    turned = lambda n: v.let(lambda n, h: v.scale(n, F.when(h < 0, -1.0).otherwise(1.0)), n, v.dot(n, constant(up)))

    def angles(n: Column) -> Column:
        azimuth = F.degrees(F.atan2(v.dot(n, constant(second)), v.dot(n, constant(first))))
        tilt = F.degrees(F.acos(F.least(F.lit(1.0), v.dot(n, constant(up)) / math.sqrt(sum(x * x for x in up)))))
        return F.struct(F.when(azimuth < 0, azimuth + 360).otherwise(azimuth).alias("azimuth"), tilt.alias("tilt"))

    return v.let(angles, turned(normal))


def orientation_bins(normals: DataFrame, up: tuple, level: tuple) -> DataFrame:
    """``(azimuth, tilt, weight)``: summed weights by whole degrees."""
    o = orientation(F.col("normal"), up, level)
    at = normals.where("normal is not null and weight > 0").select(o.alias("o"), "weight")
    return at.groupBy(F.floor("o.azimuth").cast("int").alias("azimuth"), F.floor("o.tilt").cast("int").alias("tilt")).agg(F.sum("weight").alias("weight"))


def upright(normals: DataFrame, up: tuple, level: tuple) -> tuple[float, float, float] | None:
    """The direction, at most 45 degrees off ``up``, in which most weight lies; None if there is none."""
    import numpy as np

    rows = orientation_bins(normals, up, level).where(F.col("tilt") < TILT).collect()  # 360 times 45 at most
    if not rows:
        return None
    first, second = (np.array(x) for x in level_pair(up, level))
    u = np.array(up, float) / np.linalg.norm(up)
    azimuth, tilt = (np.radians(np.array([r[k] for r in rows]) + 0.5) for k in ("azimuth", "tilt"))
    weight = np.array([float(r["weight"]) for r in rows])
    seen = np.cos(tilt)[:, None] * u + np.sin(tilt)[:, None] * (np.cos(azimuth)[:, None] * first + np.sin(azimuth)[:, None] * second)
    near = np.array([weight[seen @ s >= math.cos(math.radians(NEAR / 2))].sum() for s in seen])  # a bin alone is small near the pole
    best = seen[near.argmax()]
    for _ in range(ROUNDS):
        side = v.dot(F.col("normal"), constant(best))
        turned = v.scale(F.col("normal"), F.when(side < 0, -1.0).otherwise(1.0))
        held = normals.where("normal is not null and weight > 0").where(F.abs(side) >= math.cos(math.radians(NEAR)))
        sums = held.select(turned.alias("n"), "weight").agg(*[F.sum(F.col("n")[a] * F.col("weight")) for a in v.AXES]).first()
        if sums[0] is None:
            break
        best = np.array(sums, float) / np.linalg.norm(sums)
    return tuple(float(x) for x in best)


def level(normals: DataFrame, up: tuple, towards: tuple) -> tuple[float, float, float]:
    """The level direction, within 45 degrees of ``towards``, that most weight of the other normals is along or across."""
    import numpy as np

    first, second = (np.array(x) for x in level_pair(up, towards))
    o = orientation(F.col("normal"), up, towards)
    flat = normals.where("normal is not null and weight > 0").select(o.alias("o"), "weight").where(F.col("o.tilt") >= TILT)
    flat = flat.select(F.pmod(F.col("o.azimuth"), F.lit(90.0)).alias("turn"), "weight")
    bins = np.zeros(90)
    for r in flat.groupBy(F.floor("turn").cast("int").alias("bin")).agg(F.sum("weight").alias("weight")).collect():  # 90 at most
        bins[r["bin"] % 90] += float(r["weight"])
    if not bins.any():
        return tuple(float(x) for x in first)
    wide = sum(np.roll(bins, k) for k in (-2, -1, 0, 1, 2))
    turn = float(wide.argmax()) + 0.5
    for _ in range(ROUNDS):
        off = F.pmod(F.col("turn") - F.lit(turn) + 45, F.lit(90.0)) - 45
        mean = flat.where(F.abs(off) <= NEAR).agg(F.sum(off * F.col("weight")) / F.sum("weight")).first()[0]
        turn += mean or 0.0
    turn = math.radians((turn + 45) % 90 - 45)
    return tuple(float(x) for x in math.cos(turn) * first + math.sin(turn) * second)


def frame(normals: DataFrame, up: tuple = (0.0, 0.0, 1.0), towards: tuple = (1.0, 0.0, 0.0)) -> list[float]:
    """The rotation (nine numbers by rows) that turns the scene's upright axis to ``up`` and its level one
    to ``towards``; that of no turn if there are no normals."""
    import numpy as np

    u = np.array(up, float) / np.linalg.norm(up)
    found = upright(normals, up, towards)
    if found is None:
        return np.eye(3).ravel().tolist()
    along = np.array(level(normals, found, towards))
    own = np.stack([along, np.cross(found, along), found])
    first, second = (np.array(x) for x in level_pair(up, towards))
    return (np.stack([first, second, u]).T @ own).ravel().tolist()


def aligned(rows: DataFrame, rotation: list[float], position: str = "pos", about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``rows`` with positions turned about a point."""
    return rows.withColumn(position, v.rotate(F.col(position), v.mat(*[F.lit(x) for x in rotation]), constant(about)))


#: The upright grid: degrees of a cell, cells about the axis (quarters of a turn lie on each other) and from it.
CELL_DEGREES, TURNS, TILTS = 1.0, 90, 40
#: Degrees between the means of clusters that are one.
APART = 2.0
#: Share of the greatest cell that a cell of a peak has at least.
PEAK = 0.75


def upright_cells(normals: DataFrame, up: tuple, level: tuple) -> DataFrame:
    """The normals at most 40 degrees off the line of ``up``, with ``azimuth`` and ``tilt``, their cell, ``side``, and the turned normal ``tx, ty, tz``.

    Azimuths are folded to 0 to 90, so a cell holds normals of four directions about the axis, and of both ways along it. ``side`` tells the
    four apart once all are turned to the side of ``up``. Null normals and weights, and those without length, are left out.
    """
    import numpy as np

    first, second = (constant(x) for x in level_pair(up, level))
    n, top = F.col("normal"), constant(tuple(np.array(up, float) / np.linalg.norm(up)))
    rows = normals.where("normal is not null and weight is not null").withColumns({"_u": v.dot(n, top), "_p": v.dot(n, first), "_q": v.dot(n, second)})
    off = 90 - F.abs(F.degrees(F.acos(F.greatest(F.least(F.col("_u"), F.lit(1.0)), F.lit(-1.0)))) - 90)
    turn = F.abs(F.abs(F.degrees(F.atan2("_p", "_q"))) - 90)
    rows = rows.where("not isnan(_u)").withColumns({"_off": off, "_turn": turn, "_s": F.when(F.col("_u") < 0, -1.0).otherwise(1.0)})
    cell = {"azimuth": F.floor(F.col("_turn") / CELL_DEGREES).cast("int") % TURNS, "tilt": F.floor(F.col("_off") / CELL_DEGREES).cast("int")}
    side = (F.col("_p") * F.col("_s") >= 0).cast("int") * 2 + (F.col("_q") * F.col("_s") >= 0).cast("int")
    turned = {f"t{a}": n[a] * F.col("_s") for a in v.AXES}
    return rows.withColumns({**cell, "side": side, **turned}).where(F.col("tilt") < TILTS).drop("_u", "_p", "_q", "_off", "_turn", "_s")


def main_clusters(cells: DataFrame) -> DataFrame:
    """``(azimuth, tilt, side, n, weight, removed)``: the sides of each cell that make up its main cluster, and what the cell has in it.

    Sides whose mean normals are less than two degrees apart, directly or by way of others, are one cluster; the one of most normals stays, ties
    by the lower side. ``n`` and ``weight`` are its normals and their weight, ``removed`` the normals of the cell's other clusters. Only sums, four a
    cell at most, are shuffled.
    """
    at = ["azimuth", "tilt"]
    sums = cells.groupBy(*at, "side").agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("double")).alias("weight"), *[F.avg(f"t{a}").alias(f"m{a}") for a in v.AXES])
    sums = stash(sums.withColumn("_l", F.sqrt(sum((F.col(f"m{a}") * F.col(f"m{a}") for a in v.AXES), F.lit(0.0)))))
    x, y = sums.alias("x"), sums.alias("y")
    cosine = sum((F.col(f"x.m{a}") * F.col(f"y.m{a}") for a in v.AXES), F.lit(0.0)) / (F.col("x._l") * F.col("y._l"))
    near = x.join(y, at).where((F.col("x.side") == F.col("y.side")) | (cosine > math.cos(math.radians(APART))))
    near = stash(near.select(*at, F.col("x.side").alias("side"), F.col("y.side").alias("other")))
    label = near.groupBy(*at, "side").agg(F.min("other").alias("cluster"))
    for _ in range(2):  # four sides are linked by three steps at most
        label = near.join(label.withColumnRenamed("side", "other"), [*at, "other"]).groupBy(*at, "side").agg(F.min("cluster").alias("cluster"))
    named = stash(sums.join(label, [*at, "side"]))
    clusters = named.groupBy(*at, "cluster").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    best = clusters.groupBy(*at).agg(F.max(F.struct("n", (-F.col("cluster")).alias("_c"), "weight")).alias("b"), F.sum("n").alias("all"))
    best = best.select(*at, (-F.col("b._c")).alias("cluster"), F.col("b.n").alias("n"), F.col("b.weight").alias("weight"), (F.col("all") - F.col("b.n")).alias("removed"))
    return named.select(*at, "side", "cluster").join(best, [*at, "cluster"]).select(*at, "side", "n", "weight", "removed")


def peak_cells(grid: DataFrame, peak: float = PEAK) -> DataFrame:
    """``(azimuth, tilt, cluster, weight)``: the cells of ``grid`` (azimuth, tilt, weight) of at least that share of the greatest, in clusters that touch.

    Cells touch at eight sides and across the ends of the azimuth; those around the axis itself (tilt 0) all touch.
    """
    high = grid.agg((F.max("weight") * peak).alias("_least"))
    cells = stash(grid.crossJoin(F.broadcast(high)).where("weight >= _least").select((F.col("azimuth") * TILTS + F.col("tilt")).cast("long").alias("cell"), "azimuth", "tilt", "weight"))  # one row
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    asked = cells.select("cell", "azimuth", "tilt", F.explode(steps).alias("d")).select("cell", (F.pmod(F.col("azimuth") + F.col("d.i"), F.lit(TURNS)) * TILTS).alias("_a"), (F.col("tilt") + F.col("d.j")).alias("_t"))
    edges = asked.where(F.col("_t").between(0, TILTS - 1)).select(F.col("cell").alias("a"), (F.col("_a") + F.col("_t")).cast("long").alias("b"))
    edges = edges.join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
    pole = cells.where("tilt = 0").agg(F.min("cell").alias("b"))
    edges = edges.select("a", "b").unionByName(cells.where("tilt = 0").crossJoin(F.broadcast(pole)).select(F.col("cell").alias("a"), "b"))  # one row
    parts = connected_components(edges).withColumnRenamed("node", "cell")
    return cells.join(parts, "cell", "left").select("azimuth", "tilt", F.coalesce("component", "cell").alias("cluster"), "weight")


def upright_by_clusters(normals: DataFrame, up: tuple = (0.0, 0.0, 1.0), level: tuple = (1.0, 0.0, 0.0), peak: float = PEAK) -> DataFrame:
    """One row ``(x, y, z, n)``: the mean, by weight and at length 1, of the normals in the heaviest cluster of cells, and how many they are.

    Only main clusters of cells count (:func:`main_clusters`). Normals without a cell give no row.
    """
    cells = stash(upright_cells(normals, up, level))
    mains = stash(main_clusters(cells))
    peaks = stash(peak_cells(mains.select("azimuth", "tilt", "weight").distinct(), peak))
    heaviest = peaks.groupBy("cluster").agg(F.sum("weight").alias("total")).agg(F.max(F.struct("total", (-F.col("cluster")).alias("c"))).alias("b")).select((-F.col("b.c")).alias("cluster"))
    chosen = peaks.join(F.broadcast(heaviest), "cluster").select("azimuth", "tilt").join(mains.select("azimuth", "tilt", "side"), ["azimuth", "tilt"])
    held = cells.join(chosen, ["azimuth", "tilt", "side"])
    mean = held.agg(*[F.sum(F.col(f"t{a}") * F.col("weight")).alias(a) for a in v.AXES], F.count("*").alias("n")).where("n > 0")
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return mean.select(*[(F.col(a) / length).alias(a) for a in v.AXES], "n")
