"""Point files of delimited text, and results of bins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from .lines import tokens, write_lines


@dataclass
class PointLayout:
    """Which token (from 0) holds what: coordinates, and columns of one, three or four tokens."""

    position: tuple[int, int, int] = (0, 1, 2)
    doubles: dict[str, int] = field(default_factory=dict)
    vectors: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    colors: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        used = [*self.position, *self.doubles.values(), *(i for t in (*self.vectors.values(), *self.colors.values()) for i in t)]
        if len(set(used)) != len(used):
            raise ValueError("two columns read the same token")

    def columns(self, parts):
        at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
        out = [v.vec(*map(at, self.position)).alias("pos")]
        out += [at(i).alias(n) for n, i in self.doubles.items()]
        out += [v.vec(*map(at, t)).alias(n) for n, t in self.vectors.items()]
        for n, t in self.colors.items():
            out.append(F.struct(*[F.get(parts, F.lit(i)).try_cast("short").alias(c) for c, i in zip("rgba", t)]).alias(n))
        needed = [at(i).isNotNull() for i in (*self.position, *self.doubles.values(), *(i for t in (*self.vectors.values(), *self.colors.values()) for i in t))]
        return out, needed


def read_points(spark: SparkSession, path: str, layout: PointLayout | None = None, delimiter: str = ",") -> DataFrame:
    """``(pos, ...)``: a row for each line that has a number wherever the layout asks for one; other lines are left out."""
    parts = tokens(F.col("value"), delimiter if delimiter.strip() else None)
    columns, needed = (layout or PointLayout()).columns(F.col("_t"))
    rows = spark.read.text(path).select(parts.alias("_t"))
    for n in needed:
        rows = rows.where(n)
    return rows.select(*columns)


def write_points(points: DataFrame, path: str, separator: str = ", ", mode: str = "error") -> None:
    """Lines of x, y, z, then colour, normal and double columns, as far as there are any; no header."""
    kinds = dict(points.dtypes)
    cells = [F.col("pos")[a] for a in v.AXES]
    if "color" in kinds:
        cells += [F.col("color")[c] for c in "rgb"]
    if "normal" in kinds:
        cells += [F.col("normal")[a] for a in v.AXES]
    cells += [F.col(n) for n, k in points.dtypes if k == "double"]
    points.select(F.concat_ws(separator, *[c.cast("string") for c in cells]).alias("line")).write.mode(mode).text(path)


def write_bins(bins: DataFrame, path: str, columns: list[str], digits: int | None = None, mode: str = "error") -> None:
    """A header and lines ``x; y; value`` in order of the columns before the last, as one file."""
    text = [F.format_string(f"%.{digits}f", F.col(c).cast("double")) if digits is not None else F.col(c).cast("string") for c in columns]
    keys = columns[:-1]
    body = bins.select(F.lit(1).alias("part"), *keys, F.concat_ws("; ", *text).alias("line"))
    head = bins.limit(1).select(F.lit(0).alias("part"), *keys, F.lit("; ".join(columns)).alias("line"))
    write_lines(head.unionByName(body), path, ["part", *keys], single=True, mode=mode)


def read_bins(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What :func:`write_bins` wrote, as doubles."""
    parts = F.split("value", "; ")
    rows = spark.read.text(path).where(F.col("value") != "; ".join(columns))
    return rows.select(*[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
