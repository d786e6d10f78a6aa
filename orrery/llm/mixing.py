"""Mixing sources to target weights by capped water-filling.

The wanted total is shared out by weight; a source whose share exceeds ``max_epochs`` times
its size is clamped there, and the excess is reshared among the others by weight until no
share exceeds its cap. A source's target over its size is its number of epochs: the whole
part repeats every document, the fraction is drawn by a seeded order of the documents, taken
from the front until the wanted words are reached. The one document that stands across
that line is taken in part, so each source meets its target to within a word a stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, text_of

#: Documents that are put in order together; a larger source is split into such strata by hash.
STRATUM = 1024


def word_count(column):
    """Number of runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def number_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: the place of each source by code point, null last, from 0.

    Sources are dealt to ranges of code points first, so that no task orders all of them:
    a prefix sum over the ranges' sizes completes the ranks inside each.
    """
    key = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = stash(ranged)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    return ranged.withColumn("inside", inside).join(before, "range").withColumn("rank", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def water_fill(sources: DataFrame, weights: list[float], total_share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, size) with each one's ``target``.

    Weights repeat over the ranks. At a water level L a source gets weight * L, or its cap
    if that is less; each round computes the level that shares the total out given the sources
    clamped at the level before. The level only rises, and ends when no more are clamped.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    ranked = stash(number_sources(sources).withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(max_epochs))))
    first = ranked.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total = float(first["size"] or 0) * total_share
    level = total / first["weight"] if first["weight"] else 0.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        now = ranked.agg(F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not now["weight"]:  # all are clamped
            break
        after = (total - (now["capped"] or 0.0)) / now["weight"]
        if after <= level * (1 + 1e-12):
            break
        level = after
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return ranked.select("source", "size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: list[float] = (5, 2, 1), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
) -> DataFrame:
    """``(doc_id, row_hash, source, size, source_size, target, taken)``, a row for each row of ``docs``.

    Sizes are words; taken is how many of the document's words the mix takes, repeats counted,
    from 0 to ``max_epochs`` times its size. The total is ``total_share`` of all sizes. A null
    source is a source, last in order; null, empty and blank texts have size 0 and take 0.
    Reruns agree: the order within a source hangs on the seed, the id and the text.
    """
    text = text_of(text_col)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size")
    )
    sizes = stash(sizes)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sources = stash(sources)
    targets = water_fill(sources.select("source", "size"), list(weights), total_share, max_epochs)
    targets = targets.withColumnRenamed("size", "source_size").alias("t")
    counts = sources.select("source", "docs").alias("c")
    per_source = stash(targets.join(counts, F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.source", "source_size", "target", "docs")).alias("s")

    order = F.xxhash64(F.lit(seed), "doc_id", "row_hash").alias("order")
    stratum_of = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "row_hash"), F.ceil(F.col("docs") / STRATUM)).alias("stratum")
    rows = sizes.alias("d").join(per_source, F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("doc_id", "row_hash", "d.source", "d.size", "source_size", "target", order, stratum_of)
    stratum = Window.partitionBy("source", "stratum")
    front = stratum.orderBy("order", "doc_id", "row_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    wanted = F.round((epochs - whole) * F.sum("size").over(stratum))
    part = F.greatest(F.lit(0), F.least(F.col("size"), wanted - (F.sum("size").over(front) - F.col("size"))))
    return rows.select("doc_id", "row_hash", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
