"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch holds the k smallest hashes of a text's distinct shingles, in order. Sketches of
parts merge into the sketch of the whole, since the k smallest of a union are among the
k smallest of each part. Two sketches estimate resemblance, containment and, alone, the
number of distinct shingles; below k shingles all of that is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import WORD, Sheltered, sha256, stash, table, text_of

#: Hashes are the upper 48 bits of XXH64, as positive longs.
HASH_BITS = 48
def sketch(text: Column, k: int = 128, words: int = 5) -> Column:
    """``array<long>``: the ``k`` smallest distinct shingle hashes of a text, ascending.

    Words are runs outside [\\x20\\x09-\\x0D]; a shingle is ``words`` neighbouring words, fewer
    words make one shingle, none make none (an empty sketch; so for null and empty texts).
    """
    hashed = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: F.xxhash64(w))
    return let(lambda w: _smallest(w, words, k), hashed)


def _smallest(w: Column, words: int, k: int) -> Column:
    n = F.size(w)
    hashes = F.when(n >= words, shingles(w, words)).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, _upper))), 1, k)


def shingles(w: Column, words: int) -> Column:
    """A hash for each run of ``words`` neighbours in an array of hashes that has as many or more.

    Runs of one, two, four, ... are hashed from two shorter ones beside each other, so a
    run of n costs about 2 log(n) hashes of two numbers.
    """
    length, runs = 1, w  # runs of a power of two
    built, out = 0, None  # the runs put together so far
    while True:
        if words & length:
            out, built = (runs, length) if out is None else (let(lambda a, b: _beside(a, b, built), out, runs), built + length)  # noqa: B023
        if built == words:
            return out
        runs, length = let(lambda a: _beside(a, a, length), runs), 2 * length  # noqa: B023


def _beside(a: Column, b: Column, step: int) -> Column:
    """A hash for each run in ``a`` with the run in ``b`` that begins ``step`` places on."""
    later = F.slice(b, F.lit(step + 1), F.greatest(F.size(b) - step, F.lit(0)))
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(b) - step, F.lit(0))), later, lambda x, y: F.xxhash64(x, y))


def _upper(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - HASH_BITS)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of a whole from those of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(parts: DataFrame, key: str, column: str, k: int = 128, fan_in: int = 256) -> DataFrame:
    """``(key, column)``: the merged sketch of each key's rows.

    Sketches are merged in rounds of at most about ``fan_in`` each, so a key of any number of
    rows never meets in one task unmerged.
    """
    most = parts.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    rows = parts.select(key, column)
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k).alias(column)
    salts = -(-most // fan_in)
    while salts > 1:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(column), F.lit(salts)), F.lit(salts))).groupBy(key, "_salt").agg(merged).drop("_salt")
        salts = -(-salts // fan_in)
    return rows.groupBy(key).agg(merged)


def compare(a: Column, b: Column, k: int = 128) -> Column:
    """``struct<resemblance, containment>`` of two sketches, from one union of both.

    Resemblance is the estimated Jaccard likeness of two texts, from 0 to 1; two texts without shingles: 1.
    Containment is the estimated share of ``a``'s shingles that ``b`` holds: resemblance times
    union over size of a; 1 if ``a`` has none.
    """

    def judged(a: Column, b: Column, union: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
        alike = F.when(F.size(union) == 0, 1.0).otherwise(shared / F.size(union))
        held = F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), alike * distinct_shingles(union, k) / distinct_shingles(a, k)))
        return F.struct(alike.alias("resemblance"), held.alias("containment"))

    return let(lambda a, b: let(lambda union: judged(a, b, union), merge(a, b, k)), a, b)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    return compare(a, b, k)["resemblance"]


def containment(a: Column, b: Column, k: int = 128) -> Column:
    return compare(a, b, k)["containment"]


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's share."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / F.element_at(a, -1))


def fingerprint(a: Column) -> Column:
    """A sketch as text: its hashes in decimal."""
    return F.array_join(a.cast("array<string>"), " ")


def place_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are no larger than a value: a binary search."""
    if not cuts:
        return F.lit(0)
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    listed = F.lit(cuts).cast("array<long>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", derive=lambda rows: rows) -> DataFrame:
    """Rows ``docs`` with ``next_<c>`` for each of ``columns``: its value in the row next in order of ids,
    the first row's after the last.

    Null ids come first. Rows of one id (or none) are put in order by a hash of their texts; repeated
    rows follow each other. A single row is its own follower; an empty table gives no rows.

    Rows are dealt to buckets between quantiles of the ids, eight a shuffle partition; null ids to as
    many by their hash. The first row of a bucket goes to the bucket before as well, so
    that a window over each bucket finds every follower, and texts are shuffled once. ``derive``
    adds columns after that, once for each row.
    """
    s = Sheltered(docs)
    id_, text = s.at(id_col), s.at(text_col)
    hidden = "dealt"
    while hidden in (c.lower() for c in docs.columns):
        hidden += "_"
    n = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = (n - 1).bit_length()
    cuts = s.rows.agg(F.percentile_approx(F.col(id_).cast("long"), [i / n for i in range(1, n)], 10 * n)).first()[0]
    sign = F.lit(-(1 << 63))
    by_hash = F.shiftrightunsigned(F.col("order_hash").bitwiseXOR(sign), 64 - slices).cast("int") - F.lit(1 << slices)
    bucket = F.when(F.col(id_).isNull(), by_hash).otherwise(place_of(F.col(id_).cast("long"), sorted(set(cuts or []))))
    rows = s.rows.withColumn("order_hash", F.xxhash64(text_of(text))).withColumn("bucket", bucket)
    key = F.struct(F.col(id_).alias("id"), F.col("order_hash").alias("hash"))
    firsts = rows.groupBy("bucket").agg(F.min(key).alias("first"))
    cyclic = Window.orderBy("bucket")  # a row for each bucket, of which there are as many as shuffle partitions times a constant
    last = F.last("bucket").over(cyclic.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = stash(firsts.select("first", F.coalesce(F.lag("bucket").over(cyclic), last).alias("before")))
    both = rows.join(F.broadcast(firsts), key.eqNullSafe(F.col("first")), "left")
    own, ahead = F.struct(F.lit(0).alias("guest"), F.col("bucket").alias("at")), F.struct(F.lit(1).alias("guest"), F.col("before").alias("at"))
    sent = both.select(*s.rows.columns, "order_hash", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
    place = F.struct("at", "guest", F.col(id_).alias("id"), F.col("order_hash").alias("hash")).alias(hidden)
    dealt = derive(sent.repartition("at").select(*s.back(), place))
    order = Window.partitionBy(f"{hidden}.at").orderBy(f"{hidden}.guest", F.col(f"{hidden}.id").asc_nulls_first(), f"{hidden}.hash")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(f"{hidden}.guest = 0").drop(hidden)


def edit(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: every document beside its edited text and its follower."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pairs = with_next(docs, ["text", "own"], derive=lambda rows: rows.withColumn("own", sketch(F.col("text"))))
    edited = edit(F.col("text"), F.col("next_text"))
    both = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", F.col("next_own").alias("following"), let(lambda t: F.struct(sha256(t).alias("digest"), sketch(t).alias("changed")), edited).alias("made"))
    own = F.col("own")
    judged = both.select("doc_id", "n_chars", "made", "own", compare(own, F.col("made.changed")).alias("to_edited"), resemblance(own, F.col("following")).alias("near_next"))
    return judged.select(
        "doc_id", "n_chars", F.col("made.digest").alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(F.col("made.changed")).alias("edited_fingerprint"),
        F.col("to_edited.resemblance").alias("near_edited"), "near_next", distinct_shingles(own).alias("distinct_shingles"), F.col("to_edited.containment").alias("contained_in_edited"),
    )
