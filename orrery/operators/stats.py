"""Statistics: running and mergeable states, weighted measures, arg-min and arg-max with ties, buckets.

All of these are built-in aggregates, so Spark aggregates partially before each shuffle.
A state is the columns ``n, mean, variance, min, max``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import vectors as v
from ..storage import stash

STATE = ("n", "mean", "variance", "min", "max")


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def running(value, prefix: str = "", seeded: bool = False) -> list[Column]:
    """Aggregates for count, mean, sample variance (0 for one value), least and greatest value.

    ``seeded``: least and greatest start at 0, so the least is never above 0, the greatest never below.
    """
    x = c(value).cast("double")
    low, high = F.min(x), F.max(x)
    if seeded:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    variance = F.when(F.count(x) > 0, F.coalesce(F.var_samp(x), F.lit(0.0)))
    return [a.alias(prefix + name) for a, name in zip((F.count(x), F.avg(x), variance, low, high), STATE)]


def describe(rows: DataFrame, value, by: list[str] | None = None, seeded: bool = False) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*running(value, seeded=seeded))


def merge_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One state for each key from states of parts, by sums of counts, means and squares about the mean."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    inner = F.sum(F.when(F.col("n") > 0, (F.col("n") - 1) * F.col("variance")))
    outer = F.sum(F.col("n") * F.col("mean") * F.col("mean"))
    sums = states.groupBy(*(by or [])).agg(n.alias("n"), mean.alias("_s"), inner.alias("_in"), outer.alias("_sq"), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.try_divide(F.col("_s"), F.col("n"))
    between = F.greatest(F.col("_sq") - F.col("n") * mean * mean, F.lit(0.0))
    variance = F.when(F.col("n") > 1, (F.col("_in") + between) / (F.col("n") - 1)).when(F.col("n") > 0, 0.0)
    return sums.select(*(by or []), "n", mean.alias("mean"), variance.alias("variance"), "min", "max")


def vector_stats(vector: str) -> list[Column]:
    """The state of each component of a vector column, as ``x_n``, ``x_mean``, ..."""
    return [a for axis in "xyz" for a in running(F.col(f"{vector}.{axis}"), f"{axis}_")]


def color_stats(color: str) -> list[Column]:
    """Mean, least and greatest of each channel, truncated to 0..255."""
    byte = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")
    return [byte(f(F.col(f"{color}.{k}"))).alias(f"{k}_{name}") for k in "rgb" for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]


def circular(angle) -> list[Column]:
    """Circular mean (-pi to pi) and resultant length (1: all alike) of angles in radians; order doesn't matter."""
    s, k = F.avg(F.sin(c(angle))), F.avg(F.cos(c(angle)))
    return [F.atan2(s, k).alias("mean"), F.hypot(s, k).alias("resultant")]


def circular_running(rows: DataFrame, angle, order, by: list[str] | None = None) -> DataFrame:
    """``(by, n, mean, variance)``: the running mean by shortest differences, in a given order.

    It depends on the order, so a group is one ordered pass of one task, which holds a state and a batch of
    rows at a time, however large the group. Where order needn't matter use :func:`circular`.
    """
    by = by or []
    keys = [f"k{i}" for i in range(len(by))]
    held = rows.where(c(angle).isNotNull()).select(*[F.col(k).alias(x) for k, x in zip(by, keys)], c(order).alias("ord"), c(angle).cast("double").alias("angle"))
    dealt = (held.repartition(*keys) if keys else held.repartition(1)).sortWithinPartitions(*keys, "ord", "angle")
    types = T.StructType([held.schema[k] for k in keys])
    out = T.StructType([*types, T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType())])

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        key, state = None, (0, 0.0, 0.0)

        def done():
            n, mean, m2 = state
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, [*key, n, mean, m2 / (n - 1) if n > 1 else 0.0]))], schema=schema)

        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in range(len(keys)))) if keys else iter(lambda: (), None)
            for k, x in zip(own, batch.column(len(keys) + 1).to_pylist()):
                if key is not None and k != key:
                    yield done()
                if k != key:
                    key, state = k, (0, 0.0, 0.0)
                n, mean, m2 = state
                d = x - mean
                d += -2 * math.pi if d > math.pi else 2 * math.pi if d < -math.pi else 0.0
                state = n + 1, mean + d / (n + 1), m2 + d * d * n / (n + 1)
        if key is not None:
            yield done()

    found = dealt.mapInArrow(fold, out)
    return found.select(*[F.col(x).alias(k) for k, x in zip(by, keys)], "n", "mean", "variance")


def circular_vector(vector) -> list[Column]:
    """:func:`circular` of each component of a vector of angles, as ``x_mean``, ``x_resultant``, ..."""
    return [a.alias(f"{axis}_{name}") for axis in "xyz" for a, name in zip(circular(c(vector)[axis]), ("mean", "resultant"))]


def pose_stats(rows: DataFrame, pose: str = "pose", by: list[str] | None = None) -> DataFrame:
    """``(by, n, position, position_variance, angles, resultant, mean)``: statistics of poses.

    Positions have a mean and a sample variance (0 for one pose) by component, Euler angles a circular mean
    and a resultant length; ``mean`` is the pose of both means.
    """
    p = F.col(pose)
    held = rows.where(p.isNotNull()).withColumns({"_at": g.pose_position(p), "_turn": v.euler_from_matrix(g.pose_rotation(p))})
    position, turn = F.col("_at"), F.col("_turn")
    gather = lambda f: v.vec(*[f(a) for a in v.AXES])
    found = held.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        gather(lambda a: F.avg(position[a])).alias("position"),
        gather(lambda a: F.coalesce(F.var_samp(position[a]), F.lit(0.0))).alias("position_variance"),
        gather(lambda a: circular(turn[a])[0]).alias("angles"),
        gather(lambda a: circular(turn[a])[1]).alias("resultant"),
    )
    found = found.where("n > 0")
    return found.withColumn("mean", g.pose(v.matrix_from_euler(F.col("angles")), F.col("position")))


def weighted_mean(value, weight) -> Column:
    return F.try_divide(F.sum(c(value) * c(weight)), F.sum(c(weight)))


def mean_vector(vector, weight=None) -> Column:
    """The mean of a vector column by component, weighted if a weight is given."""
    w = F.lit(1.0) if weight is None else c(weight)
    return v.vec(*[weighted_mean(c(vector)[a], w) for a in v.AXES])


def median_vector(vector) -> Column:
    """The median of each component."""
    return v.vec(*[F.median(c(vector)[a]) for a in v.AXES])


def weighted_median_vector(rows: DataFrame, vector: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """``(by, median)``: :func:`weighted_median` of each component."""
    by = by or []
    long = rows.select(*by, F.col(weight).alias("_weight"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(vector)[a].alias("value")) for a in v.AXES])).alias("_e"))
    found = weighted_median(long.select(*by, "_weight", F.col("_e.axis").alias("_axis"), F.col("_e.value").alias("_value")), "_value", "_weight", [*by, "_axis"])
    axis = lambda a: F.max(F.when(F.col("_axis") == a, F.col("median")))
    return found.groupBy(*by).agg(v.vec(*[axis(a) for a in v.AXES]).alias("median"))


def rmse(error) -> Column:
    return F.sqrt(F.avg(c(error) * c(error)))


def median_rounded(value) -> Column:
    """The median of whole numbers, halves rounded to even."""
    return F.bround(F.median(c(value))).cast("long")


def weighted_median(rows: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """``(by, median)``: the least value at which the running weight reaches half of the total.

    Weights are first summed for each value. Distinct values are dealt to ranges; a prefix sum over the
    ranges' weights (a row for each range of a group) finds the range of the median, and only
    that one is summed value by value. So no task holds a group.
    """
    by = by or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    # written once, since a range's number must be the same for its weight and its values
    ranged = stash(sums.repartitionByRange(n, *by, "_v").withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    parts = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_part"))  # a row for each range of a group
    parts = parts.withColumns({"_to": F.sum("_part").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_part").over(group)})
    held = parts.where((F.col("_to") * 2 >= F.col("_all")) & ((F.col("_to") - F.col("_part")) * 2 < F.col("_all")))
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_range").alias("_held"), (F.col("_to") - F.col("_part")).alias("_before"), "_all")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.col("_range") == F.col("_held"))
    front = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(held, same).withColumn("_run", F.sum("_w").over(front) + F.col("_before"))
    return run.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*by).agg(F.min("_v").alias("median"))


# --- extremes ---------------------------------------------------------------------------


def extremes(rows: DataFrame, value: str, by: list[str] | None = None, largest: bool = False) -> DataFrame:
    """All rows whose value is the least (or greatest) of its group: every tie stays.

    The extreme is aggregated and joined back, so no window has to hold a group.
    """
    best = (F.max if largest else F.min)(value).alias("_best")
    if not by:
        return rows.join(F.broadcast(rows.agg(best)), F.col(value) == F.col("_best")).drop("_best")
    found = rows.groupBy(*by).agg(best)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return rows.alias("l").join(found.alias("r"), same & (F.col(f"l.{value}") == F.col("r._best"))).select("l.*")


def most_frequent(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """``(by, key, n)``: the keys that stand most often, every tie."""
    counts = rows.groupBy(*(by or []), key).agg(F.count("*").alias("n"))
    return extremes(counts, "n", by, largest=True)


def pair_extremes(a: str, b: str) -> list[Column]:
    """Least and greatest of each of two columns."""
    return [F.struct(F.min(a).alias(a), F.min(b).alias(b)).alias("low"), F.struct(F.max(a).alias(a), F.max(b).alias(b)).alias("high")]


def distinct_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row of booleans: whether all values of each column differ.

    One grouped pass for each column: each value is counted where it is shuffled to, and no
    column is expanded against another.
    """
    flags = [rows.groupBy(x).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias(x)) for x in columns]
    return reduce(lambda a, b: a.crossJoin(b), flags)  # one row each


def bucket_list(value: str, name: str) -> Column:
    return F.array_sort(F.collect_list(value)).alias(name)


def bucket_set(value: str, name: str) -> Column:
    return F.array_sort(F.collect_set(value)).alias(name)


def fit_plane(rows: DataFrame, x: str, y: str, z: str, by: list[str] | None = None) -> DataFrame:
    """``(by, origin, normal, n)``: the plane of least squares through points.

    Sums for the covariance are built-in aggregates; only its 3x3 matrix, one row for each
    group, goes to numpy for the direction of least spread.
    """
    by = by or []
    names = {"x": x, "y": y, "z": z}
    sums = [F.avg(F.col(v)).alias(f"_m{k}") for k, v in names.items()]
    sums += [F.covar_pop(names[a], names[b]).alias(f"_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    rows = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return _planes(rows, by)


def _planes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Planes from means ``_mx`` .. and covariances ``_xx`` .. of each group."""

    @F.pandas_udf("array<double>")
    def normal(xx, xy, xz, yy, yz, zz):
        import numpy as np
        import pandas as pd

        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        bad = np.isnan(m).any(axis=(1, 2))
        m[bad] = 0
        found = np.linalg.eigh(m)[1][:, :, 0]
        return pd.Series([None if b else list(v) for b, v in zip(bad, found)])

    turned = rows.withColumn("_n", normal(*[F.col(f"_{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")]))
    # towards the side of the origin of coordinates away from it
    side = F.get("_n", F.lit(0)) * F.col("_mx") + F.get("_n", F.lit(1)) * F.col("_my") + F.get("_n", F.lit(2)) * F.col("_mz")
    sign = F.when(side < 0, -1.0).otherwise(1.0)
    axis = lambda i: F.get("_n", F.lit(i)) * sign
    return turned.select(
        *by, F.struct(F.col("_mx").alias("x"), F.col("_my").alias("y"), F.col("_mz").alias("z")).alias("origin"),
        F.struct(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z")).alias("normal"), "n",
    )


def robust_plane(rows: DataFrame, x: str, y: str, z: str, by: list[str] | None = None, rounds: int = 3) -> DataFrame:
    """``(by, origin, normal, n)``: a plane that outlying points hardly turn, by reweighted least squares in a fixed number of rounds.

    Each round weighs the points by ``1 / (1 + (d / s)^2)`` with d their distance from the plane before and s its median times 1.4826, and fits anew: two
    aggregates over the rows, and a join with a plane for each group. Points without a coordinate are left out.
    """
    by = by or []
    xyz = dict(zip("xyz", (x, y, z)))
    there = rows.where(" and ".join(f"`{c}` is not null" for c in xyz.values()))
    points = stash(there.select(*by, *[F.col(c).cast("double").alias(f"_{k}") for k, c in xyz.items()]))
    planes = fit_plane(points, "_x", "_y", "_z", by)
    for _ in range(rounds):
        planes = stash(planes)
        own = planes.select(*by, *[F.col("origin")[k].alias(f"_o{k}") for k in "xyz"], *[F.col("normal")[k].alias(f"_n{k}") for k in "xyz"], F.col("n").alias("_n"))
        met = points.join(own, by) if by else points.crossJoin(F.broadcast(own))  # one row
        off = sum((F.col(f"_n{k}") * (F.col(f"_{k}") - F.col(f"_o{k}")) for k in "xyz"), F.lit(0.0))
        met = stash(met.select(*by, *[(F.col(f"_{k}") - F.col(f"_o{k}")).alias(f"_{k}") for k in "xyz"], *[F.col(f"_o{k}") for k in "xyz"], F.abs(off).alias("_d")))
        spread = met.groupBy(*by).agg((F.percentile_approx("_d", 0.5) * 1.4826).alias("_s"))
        met = met.join(spread, by) if by else met.crossJoin(F.broadcast(spread))  # one row
        weight = F.when(F.col("_s") > 0, 1 / (1 + (F.col("_d") / F.col("_s")) * (F.col("_d") / F.col("_s")))).otherwise((F.col("_d") == 0).cast("double"))
        sums = [F.sum("_w").alias("_sum"), F.count("*").alias("n"), *[F.first(f"_o{k}").alias(f"_o{k}") for k in "xyz"]]
        sums += [(F.sum(F.col("_w") * F.col(f"_{k}")) / F.sum("_w")).alias(f"_m{k}") for k in "xyz"]
        sums += [(F.sum(F.col("_w") * F.col(f"_{a}") * F.col(f"_{b}")) / F.sum("_w")).alias(f"_q{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
        moments = met.withColumn("_w", weight).groupBy(*by).agg(*sums)
        spreads = [(F.col(f"_q{a}{b}") - F.col(f"_m{a}") * F.col(f"_m{b}")).alias(f"_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
        planes = _planes(moments.select(*by, "n", *[(F.col(f"_m{k}") + F.col(f"_o{k}")).alias(f"_m{k}") for k in "xyz"], *spreads), by)
    return planes
