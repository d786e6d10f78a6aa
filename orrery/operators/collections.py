"""Ordinals, thinning, shuffles, set algebra and upserts on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash


def with_ordinal(rows: DataFrame, order: list, name: str = "ord", slices: int = 0) -> DataFrame:
    """``rows`` with a number from 0 in a given order.

    Rows are dealt to ranges of the order; a prefix sum over the ranges' sizes (a row for each
    range) completes the numbers inside each, so no task orders all rows. The order must be
    total for numbers to be the same in every run.
    """
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, since a range's number must be the same for its size and its rows
    ranged = stash(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    numbered = ranged.withColumn("_inside", inside).join(before, "_range")
    return numbered.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")


def every_nth(rows: DataFrame, n: int, order: list, first: int = 0) -> DataFrame:
    """Rows ``first``, ``first + n``, ... in a given order."""
    return with_ordinal(rows, order, "_ord").where((F.col("_ord") >= first) & ((F.col("_ord") - first) % n == 0)).drop("_ord")


def without_positions(rows: DataFrame, positions: DataFrame, order: list) -> DataFrame:
    """Rows but those at the positions (column ``ord``) of the order."""
    taken = positions.select(F.col("ord").alias("_gone"))
    return with_ordinal(rows, order, "_ord").join(taken, F.col("_ord") == F.col("_gone"), "left_anti").drop("_ord")


def first_or(rows: DataFrame, value: str, order: str, default) -> DataFrame:
    """One row ``(value)``: the value first in order, or a default if there are no rows."""
    return rows.agg(F.coalesce(F.min_by(value, order), F.lit(default)).alias(value))


def shuffled(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """In an order that hangs on the seed and the key only, so reruns agree."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def bernoulli(key: list[str], share: float, seed: int = 42) -> Column:
    """True for about a share of the keys, the same ones in each run."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def random_between(low: int, high: int, key: list[str], seed: int = 42) -> Column:
    """A whole number from ``low`` to ``high``, both included, that hangs on the seed and the key."""
    return F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(high - low + 1))


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_set(*parts: DataFrame) -> DataFrame:
    return concat(*parts).distinct()


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys aren't in ``b``; null keys are equal."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.alias("a").join(b.select(*keys).alias("b"), same, "left_anti").select("a.*")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    marked = a.distinct().withColumn("_in", F.lit(1)).unionByName(b.distinct().withColumn("_in", F.lit(2)))
    return marked.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` added, or in place of those with the same keys (unique on each side)."""
    return difference(old, new, keys).unionByName(new)


def merge_buckets(*parts: DataFrame, key: str, values: str, distinct: bool = False) -> DataFrame:
    """``(key, values)``: the arrays of each key joined into one, sorted."""
    joined = F.flatten(F.collect_list(values))
    return concat(*parts).groupBy(key).agg(F.array_sort(F.array_distinct(joined) if distinct else joined).alias(values))


def sum_buckets(*parts: DataFrame, key: str, value: str) -> DataFrame:
    return concat(*parts).groupBy(key).agg(F.sum(value).alias(value))


def line_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(differences, missing)`` for two tables ``(ord, line)``: lines that differ, lines only one has."""
    left, right = a.select("ord", F.col("line").alias("l")), b.select("ord", F.col("line").alias("r"))
    both = left.join(right, "ord", "full")
    gone = F.col("l").isNull() | F.col("r").isNull()
    return both.agg(F.coalesce(F.count_if(~gone & (F.col("l") != F.col("r"))), F.lit(0)).alias("differences"), F.coalesce(F.count_if(gone), F.lit(0)).alias("missing"))


def insert_line(lines: DataFrame, at: int, line: str) -> DataFrame:
    """``(ord, line)`` with a line put in at a position."""
    moved = lines.select(F.when(F.col("ord") >= at, F.col("ord") + 1).otherwise(F.col("ord")).alias("ord"), "line")
    return moved.unionByName(lines.sparkSession.range(1).select(F.lit(at).cast("long").alias("ord"), F.lit(line).alias("line")))


def replace_line(lines: DataFrame, at: int, line: str) -> DataFrame:
    return lines.withColumn("line", F.when(F.col("ord") == at, F.lit(line)).otherwise(F.col("line")))
