"""Text files as numbered lines, and lines as a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ord, line)``: every line with its number in its file, from 0.

    Large files are read in blocks by many tasks; a prefix sum over the blocks' line counts
    completes the numbers inside each.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1
    counts = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = counts.select("file", "_block", (F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).alias("_before"))
    numbered = raw.withColumn("_inside", inside).join(before, ["file", "_block"])
    return numbered.select("file", (F.col("_before") + F.col("_inside")).cast("long").alias("ord"), "line")


def tokens(line, delimiter: str | None = None):
    """A line's parts, empty ones left out; any white space where no delimiter is given."""
    pattern = r"\s+" if delimiter is None else "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in delimiter)
    return F.filter(F.transform(F.split(line, pattern), lambda t: F.trim(t)), lambda t: t != "")


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None, single: bool = False, mode: str = "error") -> None:
    """Column ``line`` as text. ``single`` gives one part file, for formats that must be one."""
    if single:
        lines = lines.repartition(1)
        lines = lines.sortWithinPartitions(*order) if order else lines
    elif order:
        lines = lines.orderBy(*order)
    lines.select("line").write.mode(mode).text(path)


def read_matrix(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """``(row, values)``: a file of numbers; rows of unlike length raise an error when read."""
    rows = read_lines(spark, path).select(F.col("ord").alias("row"), F.transform(tokens(F.col("line"), delimiter if delimiter.strip() else None), lambda t: t.cast("double")).alias("values")).where(F.size("values") > 0)
    widths = rows.agg(F.min(F.size("values")).alias("_low"), F.max(F.size("values")).alias("_high"))
    checked = rows.crossJoin(F.broadcast(widths))  # one row
    ragged = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.lit("rows differ in length")).cast("array<double>")).otherwise(F.col("values"))
    return checked.select("row", ragged.alias("values"))
