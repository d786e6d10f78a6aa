"""Nearest-timestamp association of two sets of timed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(
    left: DataFrame, right: DataFrame, tolerance: float, left_time: str = "t", right_time: str = "t", right_order: str = "id", by: list[str] | None = None,
) -> DataFrame:
    """``left`` with a struct column ``match``: the right row nearest in time, or null.

    Times are seconds as doubles. A difference of exactly ``tolerance`` still matches; ties go
    to the right row smallest in ``right_order``; right rows may match several left rows.

    Time is cut into slots of one tolerance: a match lies in the same slot or a neighbouring
    one. For each slot the right side keeps its rows; the left side looks into three slots.
    Where many rows share a slot, a sorted merge does the work: both sides are put in one
    time order for each slot, and each left row takes the last right row before it and the
    first after it. So a slot costs its rows, never their product.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be above 0")
    keys = [F.col(k) for k in by or []]
    names = [f"_k{i}" for i in range(len(keys))]
    slot = lambda t: F.floor(F.col(t) / F.lit(float(tolerance)))
    item = F.struct(F.col(right_time).cast("double").alias("_t"), F.col(right_order).alias("_o"), F.struct(*right.columns).alias("_row"))
    r = right.where(F.col(right_time).isNotNull()).select(*[k.alias(n) for k, n in zip(keys, names)], F.explode(F.array(*[slot(right_time) + d for d in (-1, 0, 1)])).alias("_slot"), item.alias("_r"))
    # of rows at one time only the first in order can match
    r = r.groupBy(*names, "_slot", F.col("_r._t").alias("_t")).agg(F.min_by("_r", "_r._o").alias("_r"))
    wide = left.withColumn("_left", F.struct(*left.columns))
    l = wide.select(*[k.alias(n) for k, n in zip(keys, names)], slot(left_time).alias("_slot"), F.col(left_time).cast("double").alias("_t"), "_left")  # noqa: E741
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType)))
    order = Window.partitionBy(*names, "_slot").orderBy("_t")
    before = F.last("_r", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_b", before).withColumn("_a", after).where("_left is not null")
    gap = lambda k: F.abs(F.col(f"{k}._t") - F.col("_t"))
    pick = F.when(F.col("_a").isNull() | (gap("_b") < gap("_a")), F.col("_b"))
    pick = pick.when(F.col("_b").isNull() | (gap("_a") < gap("_b")), F.col("_a"))
    pick = pick.otherwise(F.when(F.col("_b._o") <= F.col("_a._o"), F.col("_b")).otherwise(F.col("_a")))
    chosen = found.withColumn("_p", pick)
    return chosen.select("_left.*", F.when(gap("_p") <= tolerance, F.col("_p._row")).alias("match"), F.when(gap("_p") <= tolerance, gap("_p")).alias("gap"))


def frames(depth: DataFrame, color: DataFrame, poses: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """RGB-D frames: depth images with their nearest colour image and nearest pose; rows that lack one go.

    Images are ``(t, path)``, poses ``(t, pose)``.
    """
    pairs = nearest(depth, color, tolerance, right_order="path").where("match is not null")
    pairs = pairs.select("t", F.col("path").alias("depth_path"), F.col("match.path").alias("color_path"))
    posed = nearest(pairs, poses, tolerance, right_order="t").where("match is not null")
    return posed.select("t", "depth_path", "color_path", F.col("match.pose").alias("pose"))
