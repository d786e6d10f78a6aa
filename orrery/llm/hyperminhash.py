"""Near-duplicates by HyperMinHash.

A document's set of shingles has a register for each of 128 hash functions. A register compresses the least
hash of its bucket to 16 bits: the count of its leading zeros, and the ten bits that follow the first one. Bands of five
registers meet equal ones; two documents of likeness 0.85 share a band but for one in ten thousand. Of pairs that meet, the
likeness is estimated from the share of equal registers, corrected for registers that are equal by chance, and
those that reach the wanted likeness, less four standard deviations, are verified on their whole sets of shingles.

Documents of equal sets are one node, so copies form no pairs. In a bucket each node first meets the least one, and
of those that it meets so the likeliest is verified; links are contracted, and nodes of one class needn't meet again. That is
repeated with the least node of another class. What is left in a bucket are classes
of which no link is known. A small bucket has their pairs compared; in a crowded one, whose pairs would grow with its square,
two nodes meet only if they share one of their rarest shingles (prefix filtering): sets of n and m shingles that are 0.85 alike share c =
0.85 (n + m) / 1.85 or more, so in any common order the first one they share is among the first n - c + 1 and m - c + 1. This misses no pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stash, table
from .simhash import shingle_hashes

#: Registers, and bits that each keeps of the hash's mantissa.
REGISTERS, MANTISSA = 128, 10
#: Registers of the sketches that nodes of crowded buckets get.
DEEP = 512
#: Bands, and registers in each.
BANDS, WIDTH = 16, 5
#: Standard deviations that an estimate may lie below the wanted likeness.
DEVIATIONS = 4
#: Most rounds in which each node meets the least one of another class; what they leave, the last steps find.
STARS = 3
#: Nodes of a bucket whose pairs are compared; larger buckets are searched by rare shingles, with the same result.
CROWDED = 16
#: Rarest shingles of a set that each posting has at hand, to see whether a pair met before.
EARLIER = 64
BLOCK = 512

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1 << 63, size=(REGISTERS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
DEEP_FACTORS = np.random.default_rng(12).integers(1 << 63, size=(DEEP, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _rng.integers(1 << 63, size=(BANDS, WIDTH)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The least hash of a set under each of several functions."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[None, i : i + BLOCK] * factors).min(axis=1), out=least)
    return least


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of 16 bits: leading zeros, up to 62, and the mantissa's first bits."""
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 62).astype(np.uint64)
    zeros += ((least << zeros) >> np.uint64(63) == 0) & (zeros < 62)  # where rounding reached the next power of two
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def chance(n: np.ndarray) -> np.ndarray:
    """How often the registers of two disjoint sets of ``n`` shingles are equal: both minima have as many
    leading zeros, and equal mantissa bits."""
    power = -np.arange(64, dtype=np.float64)
    above = np.exp(n[:, None] * np.log1p(-np.exp2(power - 1))[None, :])
    at_least = np.concatenate([np.zeros((len(n), 1)), above[:, :-1]], axis=1)
    return ((above - at_least) ** 2).sum(axis=1) / (1 << MANTISSA)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the rows' registers."""
    cut = registers[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).astype(np.uint64)
    keys = ((cut + np.uint64(1)) * MIXERS[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, text_key, n, set, chance, sig, bands)``, a row for each row of ``docs``.

    ``n`` is the number of distinct shingles and ``set`` a 128-bit hash of them; ``sig`` has four registers to a number. The
    last three are null for texts without words.
    """

    def batches(it):
        for batch in it:
            sets = [shingles(x.as_py(), words) for x in batch.column(2).cast(pa.binary())]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            registers = compressed(np.array([minima(x) for x in sets]).reshape(-1, REGISTERS))
            lists = [pa.array(list(x), pa.list_(pa.int64()), mask=n == 0) for x in (registers.view(np.int64), bands(registers))]
            prints = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            columns = [batch.column(0), batch.column(1), pa.array(n), prints, pa.array(chance(n), mask=n == 0), *lists]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "n", "set", "chance", "sig", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, text_key struct<a:long,b:long>, n long, set binary, chance double, sig array<long>, bands array<long>")


def text_key(text_col: str) -> Column:
    text = F.col(text_col).cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _unlike(x: Column) -> Column:
    """How many of the four registers in a number are not 0."""
    lanes, carry = F.lit(0x0000FFFF0000FFFF), F.lit(0x0001000000010000)  # a lane that isn't zero carries into the bit above it
    return sum(F.bit_count((two.bitwiseAND(lanes) + lanes).bitwiseAND(carry)) for two in (F.shiftrightunsigned(x, 16), x))


def estimate(a: str, b: str, differing: Column | None = None, registers: int = REGISTERS) -> Column:
    """The likeness of two nodes (structs of ``sig`` and ``chance``) by their registers, corrected for equality by chance."""
    if differing is None:
        pairs = [F.get(F.col(f"{a}.sig"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.sig"), F.lit(i))) for i in range(REGISTERS // 4)]
        differing = sum(map(_unlike, pairs), F.lit(0))
    lucky = F.sqrt(F.col(f"{a}.chance") * F.col(f"{b}.chance"))
    return (1 - differing / registers - lucky) / (1 - lucky)


def least_estimate(percent: int, registers: int = REGISTERS) -> float:
    j = percent / 100
    return j - DEVIATIONS * (j * (1 - j) / registers) ** 0.5


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes' sizes allow the likeness, and their registers make it likely."""
    sizes = (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * percent)
    return sizes & (estimate(a, b) >= least_estimate(percent))


def may_link_deeply(a: str, b: str, percent: int) -> Column:
    """The same by four times the registers, in column ``deep``, for pairs that passed :func:`may_link`."""
    differing = F.aggregate(F.zip_with(F.col(f"{a}.deep"), F.col(f"{b}.deep"), lambda x, y: _unlike(x.bitwiseXOR(y))), F.lit(0), lambda s, t: s + t)
    return estimate(f"{a}.s", f"{b}.s", differing, DEEP) >= least_estimate(percent, DEEP)


SKETCH = ("n", "chance", "sig")


def with_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the sketches of both, ``x`` and ``y``."""
    side = lambda end, name: nodes.select(F.col("set").alias(end), F.struct(*SKETCH).alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def star_pairs(postings: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)``: for each node that the sketches make likely to link with the least node of another class in
    one of its buckets, the likeliest of these. At most one a node. ``classes`` (node, component) may lack nodes."""
    known = postings.join(classes, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("component", "set").alias("class"))
    known = stash(known)
    least = known.groupBy("key").agg(F.min(F.struct("class", "set")).alias("least"), F.max("class").alias("most")).where("least.class < most")
    met = known.join(least, "key").where("class <> least.class").select(F.col("least.set").alias("a"), F.col("set").alias("b")).distinct()
    full = with_sketches(met, nodes).where(may_link("x", "y", percent))
    return full.groupBy("b").agg(F.max_by("a", estimate("x", "y")).alias("a")).select("a", "b")


def mixed_buckets(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, set, class, size)``: the buckets in which several classes still meet, with the number of their nodes."""
    known = postings.join(classes, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("component", "set").alias("class"))
    mixed = known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size")).where("low < high")
    return stash(known.join(mixed.select("key", "size"), "key"))


def pairs_across(held: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different classes in one small bucket that their sketches make likely to link."""
    full = stash(held.where(F.col("size") <= CROWDED).join(nodes.select("set", F.struct(*SKETCH).alias("s")), "set").select("key", "set", "class", "s"))
    met = full.alias("l").join(full.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class")) & may_link("l.s", "r.s", percent))
    return met.select(F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")).distinct()


def meetings_by_rare_shingles(held: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different classes that meet in a crowded bucket, share a shingle of their prefixes and are likely to link.

    Shingles are ordered by how many of the crowded buckets' sets hold them, so prefixes have rare ones. The longer
    of two sets is tried with a prefix for all lengths that may link, the shorter one with that for its own length and above, and
    the place of the shared shingle must leave enough behind it in both. A pair meets at the first shingle that both share and not again at the
    next ones, as far as the first :data:`EARLIER` of each tell; beyond these it may come again. What is left is estimated by :data:`DEEP` registers, made for these sets only.
    """
    crowd = held.where(F.col("size") > CROWDED).select("set", "class").distinct()
    texts = stash(texts_of(docs, nodes.join(crowd, "set", "left_semi"), text_col))

    def batches(it):
        for batch in it:
            sets = [shingles(x.as_py(), words) for x in batch.column(1).cast(pa.binary())]
            of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            found = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            for i in range(0, len(of), 1 << 15):
                yield pa.record_batch([batch.column(0).take(pa.array(of[i : i + (1 << 15)])), pa.array(found[i : i + (1 << 15)])], names=["set", "shingle"])

    def sketch(it):
        for batch in it:
            deep = [compressed(minima(shingles(x.as_py(), words), DEEP_FACTORS)).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(deep, pa.list_(pa.int64()))], names=["deep_set", "deep"])

    exploded = stash(texts.mapInArrow(batches, "set binary, shingle long"))
    deep = stash(texts.mapInArrow(sketch, "deep_set binary, deep array<long>"))
    rarity = exploded.groupBy("shingle").agg(F.count("*").alias("holders"))
    ranked = exploded.join(rarity, "shingle").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("order"))
    n = F.size("order")
    prefix = F.slice("order", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
    filed = ranked.select("set", F.slice(prefix["shingle"], 1, EARLIER).alias("first"), F.posexplode(prefix["shingle"]).alias("pos", "shingle"))
    filed = filed.select("set", "pos", "shingle", F.slice("first", F.lit(1), F.least("pos", F.lit(EARLIER))).alias("before")).join(crowd, "set")
    filed = filed.join(nodes.select("set", F.struct(*SKETCH).alias("s")), "set")
    filed = stash(filed.join(deep, F.col("set") == F.col("deep_set")).drop("deep_set"))
    # sets of n and m shingles must share this many, so their first common one leaves as many behind it in both
    l, r = F.col("l.s.n"), F.col("r.s.n")
    common = lambda size: F.ceil(size * percent / (100 + percent))
    smaller = (l < r) | ((l == r) & (F.col("l.set") < F.col("r.set")))
    placed = (F.col("l.pos") <= l - common(l + r)) & (F.col("r.pos") <= r - common(l + r))
    on = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.class") != F.col("r.class")) & smaller & placed
    on = on & ~F.arrays_overlap("l.before", "r.before") & may_link("l.s", "r.s", percent) & may_link_deeply("l", "r", percent)
    short = filed.where(F.col("pos") <= F.col("s.n") - common(2 * F.col("s.n")))
    met = short.alias("l").join(filed.alias("r"), on)
    return met.select(F.col("l.set").alias("a"), F.col("r.set").alias("b"))


def texts_of(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """``(set, text)``: a text for each of the ``nodes`` (set, text_key)."""
    rows = docs.select(text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.join(nodes.select("set", "text_key"), "text_key").groupBy("set").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets of shingles have an intersection of ``percent`` of their union or more."""

    def batches(it):
        for batch in it:
            kept, seen = [], {}
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns[:2]), *(c.cast(pa.binary()) for c in batch.columns[2:])):
                for key, text in ((a, text_a), (b, text_b)):
                    if key not in seen:
                        seen[key] = shingles(text.as_py(), words)
                x, y = seen[a], seen[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ends = pairs.select(F.col("a").alias("set")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = stash(texts_of(docs, nodes.join(ends, "set", "left_semi"), text_col))
    side = lambda end: texts.select(F.col("set").alias(end), F.col("text").alias(f"text_{end}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return stash(full.mapInArrow(batches, "a binary, b binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    Two rows are linked if their sets of distinct shingles have an intersection of ``percent`` of their union or
    more. component_id is the smallest id reachable, the row's own included; kept says that it is the
    row's own. Null, empty and blank texts have an empty set and link with nothing. Repeated rows each get
    their row; rows of one id with different texts are judged by their texts. A null id gets the class of its
    set (null if only null ids are reachable) and isn't kept. An empty table gives no rows.
    """
    found = stash(sketches(docs, id_col, text_col, words))
    with_words = found.where("n > 0")
    nodes = stash(with_words.groupBy("set").agg(F.min("doc_id").alias("least_id"), F.first(F.struct("text_key", "n", "chance", "sig", "bands")).alias("s")).select("set", "least_id", "s.*"))
    postings = stash(nodes.select("set", F.explode("bands").alias("key")))
    crowd = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    postings = stash(postings.join(crowd.select("key"), "key"))
    edges, parts = [], nodes.select(F.col("set").alias("node"), F.col("set").alias("component")).where("false")
    tried = nodes.select(F.col("set").alias("a"), F.col("set").alias("b")).where("false")

    def true(pairs: DataFrame) -> bool:
        """Whether pairs that were not tried before have links; classes are contracted over these."""
        nonlocal tried, parts
        fresh = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return False
        tried = tried.unionByName(fresh)
        found = verified(fresh, docs, nodes, text_col, words, percent)
        if found.isEmpty():
            return False
        edges.append(found)
        parts = connected_components(reduce(DataFrame.unionByName, edges))
        return True

    for _ in range(STARS):
        if not true(star_pairs(postings, parts, nodes, percent)):
            break
    held = mixed_buckets(postings, parts)
    if true(pairs_across(held, nodes, percent)):
        held = mixed_buckets(postings, parts)
    if not held.where(F.col("size") > CROWDED).isEmpty():
        true(meetings_by_rare_shingles(held, nodes, docs, text_col, words, percent).distinct())
    classes = nodes.join(parts, F.col("set") == F.col("node"), "left").select("set", "least_id", F.coalesce("component", "set").alias("class"))
    least = classes.groupBy("class").agg(F.min("least_id").alias("component_id"))
    named = stash(classes.join(least, "class").select(F.col("set").alias("named"), "component_id"))
    own = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set")).alias("named"))
    joined = own.where("named is not null").join(named, "named").unionByName(own.where("named is null").withColumn("component_id", F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
