"""Shared helpers of the training-data operators: reading tables, bounding batches, texts and digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stash, work_dir  # noqa: F401

#: Characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A maximal run of other characters (Java regular expression).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows sent to a Python worker at once; they hold whole documents.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    # Python workers started later find this package also if only the driver's path has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's Arrow batches to :data:`ARROW_ROWS` rows where they are larger, as its default is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


class Sheltered:
    """A caller's rows under names that no operator uses, so that their columns may be called anything.

    ``rows`` holds them as given_0, given_1, ...; ``[name]`` is one of them. An operator's own
    columns replace those of the same name (as Spark compares names) and leave all others alone.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"given_{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        found = [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{name}: {len(found)} such columns among {self.names}")
        return f"given_{found[0]}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self.at(name))

    def back(self, *replaced: str) -> list[Column]:
        """The columns under the caller's names, but for those that are replaced."""
        gone = {n.lower() for n in replaced}
        return [F.col(f"given_{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in gone]

    def with_columns(self, rows: DataFrame, **new: Column) -> DataFrame:
        """The caller's columns in their order, some of them with new values."""
        value = {k.lower(): v for k, v in new.items()}
        return rows.select(*[value.get(n.lower(), F.col(f"given_{i}")).alias(n) for i, n in enumerate(self.names)])


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def sha256(column: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)
