"""Dropping lines that earlier documents hold already, with levelled sorted runs of line hashes.

Documents come in batches of rising ids. The runs hold the hash of every line seen so far,
each with the first document that held it. A new batch merge-anti-joins the runs and adds
the hashes left over as a sorted run of level 0; when a level has ``fanout`` runs they are
compacted into one run of the next, so that n batches leave about log(n) runs to join.

A run is a table bucketed and sorted by its hashes. Runs have as many buckets as shuffles have
partitions, so an anti-join reads them as they lie and merges them with the batch, and a compaction
merges runs with each other, without moving or sorting them. Main path in DataFrame
functions only. Lines travel as two 64-bit hashes and a position, texts are shuffled once,
at the end.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Sheltered, sha256, stash, table, text_of, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Order of a null document id: after all others.
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


class LineRuns:
    """The levelled runs: ``levels[k]`` lists the written runs ``(h1, h2, owner)`` of level k, by table name.

    ``close`` drops them; what :meth:`owners` gave must be written by then.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.written: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch ``(h1, h2, did)`` that no run holds, each with its first document."""
        new = lines.groupBy("h1", "h2").agg(F.min("did").alias("owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return new

    def add(self, lines: DataFrame) -> None:
        """Take in a batch whose ids are all above those of the batches before."""
        self._push(0, self._write(self.fresh(lines)))

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs without a line in common as one."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.withColumnRenamed("owner", "other").hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))

        return reduce(both, runs)

    def _path(self, name: str) -> str:
        return f"{work_dir(self.spark)}/{name}"

    def _write(self, run: DataFrame) -> str:
        name = f"orrery_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd")
        writer.option("path", self._path(name)).saveAsTable(name)
        self.written.append(name)
        return name

    def _push(self, k: int, run: str) -> None:
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) >= self.fanout:
            merged = self._write(self.merged([self.spark.table(r) for r in self.levels[k]]))
            self.levels[k] = []
            self._push(k + 1, merged)

    def owners(self) -> DataFrame:
        """The first document of every line seen, a row for each line.

        Read as plain files: a join that shuffles both sides can split the lines that many documents hold.
        """
        return reduce(DataFrame.unionByName, [self.spark.read.schema("h1 long, h2 long, owner long").parquet(self._path(r)) for level in self.levels for r in level])

    def close(self) -> None:
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Let Spark rely on the order in which buckets of one file each were written, for plans made inside."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with three more columns, ``kept_text``, ``n_lines`` and ``n_dropped``, in place of any of these names.

    A text is split at \\n (null or empty: one empty line). A line whose key (see
    :func:`line_key`) has ``min_chars`` code points or more and occurs in several documents
    stays in the smallest id that holds it, as often as it stands there, and goes from all
    others. Rows that share an id are one document in this; a null id comes after all others.
    Repeated rows each keep their row; an empty table gives no rows. How ids are cut into
    batches changes nothing in the result.
    """
    given = Sheltered(docs)
    source = given.rows.withColumn("did", F.coalesce(given[id_col].cast("long"), F.lit(LAST_ID))).withColumn("text", text_of(given[text_col]))
    source = source.withColumn("row", F.xxhash64("text"))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(source.agg(F.percentile_approx("did", shares, 1000)).first()[0] or [])) if shares else []
    batch = reduce(lambda a, b: a + b, [(F.col("did") > c).cast("int") for c in cuts], F.lit(0))
    lines = source.select(batch.alias("batch"), "did", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars)
    lines = stash(lines.select("batch", "did", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "batch")

    runs = LineRuns(docs.sparkSession, fanout)
    with sorted_buckets(docs.sparkSession):
        for i in range(len(cuts) + 1):
            runs.add(lines.where(F.col("batch") == i))
    gone = lines.join(runs.owners(), ["h1", "h2"]).where("owner < did")
    gone = stash(gone.groupBy(F.col("did").alias("gone_did"), F.col("row").alias("gone_row")).agg(F.collect_set("pos").alias("gone")))
    runs.close()

    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    joined = source.join(gone, F.expr("did = gone_did and row = gone_row"), "left").withColumn("parts", parts)
    counts = {"total": F.size("parts").cast("long"), "dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    joined = joined.withColumns({"kept": text, **counts})  # apart from the names of the caller's columns
    own = {"kept_text": "kept", "n_lines": "total", "n_dropped": "dropped"}
    return joined.select(*given.back(*own), *[F.col(c).alias(name) for name, c in own.items()])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = drop_repeated_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT row_id, doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM docs),
keyed AS (SELECT row_id, doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.row_id, k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone
    FROM keyed k LEFT JOIN owners o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""
