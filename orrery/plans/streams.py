"""Streaming queries, run over what the tables hold and then read as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import streaming
from ..registry import query, table
from ..storage import work_dir


def drained(stream, name: str):
    """All rows of a stream that ends, in complete mode, as a table."""
    spark = stream.sparkSession
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    run = stream.writeStream.outputMode("complete").format("memory").queryName(view).option("checkpointLocation", f"{work_dir(spark)}/stream-{view}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(view)


def arriving(spark, d, name: str):
    """A table as a stream of its files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_stats", """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def stream_stats(spark, d):
    found = drained(streaming.running_stats(arriving(spark, d, "events"), "value", ["event_type"]), "stats")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "min", "max")


@query("stream_histogram", "SELECT CAST(trunc(value / 20.0) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1")
def stream_histogram(spark, d):
    return drained(streaming.running_histogram(arriving(spark, d, "events"), "value", 20.0), "histogram")


@query("stream_windows", """
SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def stream_windows(spark, d):
    found = drained(streaming.windowed_stats(arriving(spark, d, "events"), "value", "ts", ["event_type"], "1 day", "40 days"), "windows")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
