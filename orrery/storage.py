"""Cutting lineage: intermediate results as tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where none is set and the driver runs all tasks, as in tests."""
    global _local_dir
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="orrery-")
    return _local_dir


def stash(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/orrery-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    found = spark.read.schema(schema).parquet(path)
    found._stashed_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stash` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stashed_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
