"""JSON documents of points, values and cameras, and result tables as delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.collections import with_ordinal
from .lines import read_lines, write_lines

CAMERA = "camera_id long, width int, height int, intrinsics struct<fx:double,fy:double,cx:double,cy:double>, pose array<double>, k1 double, k2 double"


def write_points_json(points: DataFrame, path: str, order: list[str], key: str = "points", position: str = "pos", mode: str = "error") -> None:
    """One document ``{"key": [[x, y, z], ...]}``, a line for each point, in order; a null position is ``[]``.

    Rows are turned to text by all tasks and written by one, as the document is one file.
    """
    p = F.col(position)
    triple = F.concat(F.lit("["), F.concat_ws(", ", *[p[a].cast("double").cast("string") for a in "xyz"]), F.lit("]"))
    rows = with_ordinal(points, order, "_ord").select("_ord", F.when(p.isNull(), F.lit("[]")).otherwise(triple).alias("line"))
    last = rows.agg(F.max("_ord").alias("_last"))
    body = rows.crossJoin(F.broadcast(last)).select("_ord", F.concat("line", F.when(F.col("_ord") < F.col("_last"), F.lit(",")).otherwise(F.lit(""))).alias("line"))  # one row
    ends = points.sparkSession.createDataFrame([(-1, f'{{"{key}": ['), ((1 << 62), "]}")], "_ord long, line string")
    write_lines(ends.unionByName(body), path, ["_ord"], single=True, mode=mode)


def read_points_json(spark: SparkSession, path: str, key: str = "points") -> DataFrame:
    """``(ord, pos)`` of documents as :func:`write_points_json` writes them, a line for each point, so that a large one is read in blocks."""
    rows = read_lines(spark, path).withColumn("v", F.from_json(F.regexp_replace("line", ",$", ""), "array<double>"))
    inner = rows.where(F.col("line").startswith("[")).select((F.col("ord") - 1).alias("ord"), "v")
    return inner.select("ord", F.when(F.size("v") == 3, F.struct(*[F.get("v", F.lit(i)).alias(a) for i, a in enumerate("xyz")])).alias("pos"))


def document(**values: Column) -> Column:
    """One JSON object of scalars, vectors (structs) and matrices (arrays) of a row, indented."""
    return F.to_json(F.struct(*[x.alias(n) for n, x in values.items()]), {"pretty": "true"})


def write_cameras(cameras: DataFrame, path: str, mode: str = "error") -> None:
    """Cameras as a JSON object a line: size, intrinsics, and, as far as there are any, pose and radial distortion."""
    kept = [f.name for f in T._parse_datatype_string(CAMERA) if f.name in cameras.columns]
    cameras.select(*kept).write.mode(mode).json(path)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``(camera_id, width, height, intrinsics, pose, k1, k2)``; what a file hasn't is null, distortion 0."""
    return spark.read.schema(CAMERA).json(path).fillna(0.0, ["k1", "k2"])


def write_results(rows: DataFrame, path: str, columns: list[str], order: list[str], digits: int = 4, single: bool = True, mode: str = "error") -> None:
    """A header and a line for each row, parts set apart by ``"; "``, fractions with so many digits, nulls empty.

    ``single`` gives one file; without it each part file has its header.
    """
    kinds = dict(rows.dtypes)
    text = lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double")) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c).cast("string")
    line = F.concat_ws("; ", *[F.when(F.col(c).isNull(), F.lit("")).otherwise(text(c)) for c in columns])
    body = with_ordinal(rows, order, "_ord").select("_ord", line.alias("line"))
    if single:
        top = rows.sparkSession.createDataFrame([(-1, "; ".join(columns))], "_ord long, line string")
        return write_lines(top.unionByName(body), path, ["_ord"], single=True, mode=mode)
    named = F.struct(*[F.when(F.col(c).isNull(), F.lit("")).otherwise(text(c)).alias(c) for c in columns])
    rows.select(named.alias("r")).select("r.*").write.mode(mode).option("sep", "; ").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a table."""
    return spark.read.schema(schema).option("sep", "; ").option("header", True).csv(path)
