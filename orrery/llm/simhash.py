"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, in eight byte positions. Two fingerprints that differ in at
most three bits differ in at most three bytes and so share at least five positional bytes:
the guaranteed minimum. A posting list of one positional byte would hold 1/256 of all
fingerprints, and its pairs grow with the square of the corpus; so the postings are those of
four positional bytes together. Fourteen such sets are enough: any three positions lie in
one set of the Steiner system S(3, 4, 8), and the four positions outside that set are then shared.
Every pair that meets has its shared positional bytes tallied, stays if it reaches the minimum,
and is then verified on its bits; it counts under the first of its keys only. Equal
fingerprints are collapsed before, so copies form no pairs at all.

SimHash bits of texts whose shingles are only 0.8 alike differ in about ten of 64 places,
beyond what shared bytes can index. :func:`alike` therefore also keeps a wider fingerprint
in the same kind of index: its positional bytes are those of minwise hashes, of which such texts
share about 0.8. Pairs that share a set of these bytes are tallied over all positions, and those
that reach the minimum are verified on their shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stash, table

#: Byte positions of a SimHash, and how many of them a key holds: 32 bits, by which few unlike fingerprints meet.
POSITIONS, WIDTH = 8, 4
#: Most bits in which linked SimHashes may differ.
MOST_BITS = 3
#: Positional bytes of a minwise fingerprint, and the number of keys, which have four of them each.
MINWISE, MIN_KEYS = 128, 8
#: How far below the wanted likeness a tally may be by chance: at 0.8 about 2.5 standard deviations for the pair
#: of a text and the first under its key, about one for other pairs.
CHANCE, CLOSE = 0.09, 0.03
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """The XXH64 hashes of a UTF-8 text's shingles, repeats included.

    A-Z are lower-cased, words are runs of bytes outside [\\x20\\x09-\\x0D], shingles are ``words``
    neighbouring words joined by a space; fewer words make one shingle, none (or null) none.
    """
    tokens = text.lower().split() if text else []
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)] if tokens else []
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Unsigned SimHash: a bit is 1 if set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text's shingles."""
    return majority(shingle_hashes(text, words, seed))


def minwise(hashes: np.ndarray) -> list[int] | None:
    """The low bytes of :data:`MINWISE` minwise hashes, eight to a number; None without any shingle."""
    if not len(hashes):
        return None
    rng = np.random.default_rng(5)
    factor, shift = rng.integers(1 << 63, size=(2, MINWISE, 1)).astype(np.uint64)
    least = np.full(MINWISE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 11):
        part = hashes[None, i : i + (1 << 11)] * (factor | np.uint64(1)) + shift
        part ^= part >> np.uint64(32)
        least = np.minimum(least, part.min(axis=1))
    return least.astype(np.uint8).view("<i8").tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, wide: bool = False) -> DataFrame:
    """``(doc_id, fp)``: the SimHash of every row, as a signed long; with ``wide`` also ``sig``, its minwise bytes."""

    def batches(it):
        for batch in it:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            found = [shingle_hashes(x, words) for x in texts]
            columns = [batch.column(0), pa.array(np.fromiter(map(majority, found), dtype=np.uint64, count=len(found)).view(np.int64))]
            if wide:
                columns.append(pa.array([minwise(x) for x in found], pa.list_(pa.int64())))
            yield pa.record_batch(columns, names=["doc_id", "fp", "sig"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, fp long" + ", sig array<long>" * wide)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte(position: int) -> int:
    """The mask of one byte position, 0 being the highest byte."""
    return _signed(0xFF << (56 - 8 * position))


def index_keys() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions, of which any five positions hold one.

    Positions are the vectors of three bits; a set is four of them that add up to zero, which are the
    blocks of S(3, 4, 8). The positions outside a block are a block too.
    """
    return [c for c in combinations(range(POSITIONS), WIDTH) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def links(fps: DataFrame, max_bits: int = MOST_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose fingerprints differ in at most ``max_bits`` bits (0 to 3).

    ``fps``: distinct ``fp`` with a unique ``node`` each. Every pair comes once.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"max_bits must be from 0 to {MOST_BITS}: beyond, shared bytes are too few to index")
    keys = index_keys()
    held = lambda fp, key: F.xxhash64(fp.bitwiseAND(F.lit(_signed(sum(_byte(p) & (1 << 64) - 1 for p in key)))), F.lit(keys.index(key)))
    index = fps.select("fp", F.posexplode(F.array(*[held(F.col("fp"), k) for k in keys])).alias("number", "key"))
    left, right = index.alias("l"), index.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    shared = sum((F.when(x.bitwiseAND(F.lit(_byte(p))) == 0, 1 << p).otherwise(0) for p in range(POSITIONS)), F.lit(0))
    sets = [sum(1 << p for p in k) for k in keys]
    first = [next((i for i, s in enumerate(sets) if m & s == s), -1) for m in range(1 << POSITIONS)]
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.number") == F.col("r.number")) & (F.col("l.fp") < F.col("r.fp"))
    tallied = (F.bit_count(shared) >= POSITIONS - max_bits) & (F.get(F.lit(first), shared) == F.col("l.number"))
    verified = F.bit_count(x) <= max_bits
    pairs = left.join(right, on & tallied & verified).select(F.col("l.fp").alias("fp_a"), F.col("r.fp").alias("fp_b"))
    named = lambda end: fps.select(F.col("fp").alias(f"fp_{end}"), F.col("node").alias(end))
    return pairs.join(named("a"), "fp_a").join(named("b"), "fp_b").select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MOST_BITS
) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    component_id is the smallest id reachable over links of at most ``max_bits`` differing
    bits, the row's own included. Null, empty and blank texts have fingerprint 0 and link
    like any other; repeated rows each get their row; a null id gets the class of its
    fingerprint (null if only null ids share it). An empty table gives no rows.
    """
    fps = stash(fingerprints(docs, id_col, text_col, words))
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = connected_components(links(nodes.where("node is not null"), max_bits))
    classes = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(stash(classes), "fp").select("doc_id", "fp", "component_id")


def minwise_index(nodes: DataFrame) -> DataFrame:
    """``(t, key, node)``: the postings of ``nodes`` (node, sig) under :data:`MIN_KEYS` sets of four positional bytes."""
    half = lambda t: F.get("sig", F.lit(t // 2)).bitwiseAND(F.lit(_signed(0xFFFFFFFF << 32 * (t % 2))))
    return nodes.select(F.posexplode(F.array(*[half(t) for t in range(MIN_KEYS)])).alias("t", "key"), "node")


def tally(a: str, b: str) -> Column:
    """How many positional bytes two minwise fingerprints share."""
    differing = F.lit(0)
    for i in range(MINWISE // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return MINWISE - differing


def pairs_with_first(index: DataFrame, nodes: DataFrame, likeness: float) -> DataFrame:
    """Pairs ``(a, b)`` of a text with the first one under one of its keys, that share as many positional bytes as
    texts of this likeness do but for chance. There are at most as many as postings."""
    firsts = index.groupBy("t", "key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = stash(index.join(firsts, ["t", "key"]).where("node > a").select("a", F.col("node").alias("b")).distinct())
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return full.where(tally("sig_a", "sig_b") >= MINWISE * (likeness - CHANCE)).select("a", "b")


def pairs_across(index: DataFrame, nodes: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """Pairs ``(a, b)`` under one key in different classes ``(node, component)`` that share about as many positional
    bytes as texts of this likeness. Only keys under which classes still meet are looked at."""
    known = index.join(classes, "node", "left").select("t", "key", "node", F.coalesce("component", "node").alias("class"))
    mixed = known.groupBy("t", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    held = stash(known.join(mixed.select("t", "key"), ["t", "key"], "left_semi").join(nodes, "node"))
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class"))
    met = held.alias("l").join(held.alias("r"), on & (tally("l.sig", "r.sig") >= MINWISE * (likeness - CLOSE)))
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, likeness: float, words: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts ``(node, text)`` share that part of their distinct shingles or more."""

    def batches(it):
        for batch in it:
            kept, seen = [], {}
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns[:2]), *(c.cast(pa.binary()) for c in batch.columns[2:])):
                for node, text in ((a, text_a), (b, text_b)):
                    if node not in seen:
                        seen[node] = np.unique(shingle_hashes(text.as_py(), words))
                x, y = seen[a], seen[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= likeness * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(batches, "a long, b long")


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8, max_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, component_id)``, a row for each row of ``docs``.

    component_id is the smallest id reachable over links between texts of which at least ``likeness`` of
    the distinct shingles are shared, all blank texts being alike; the row's own id is included.
    Candidates are met by SimHash (at most ``max_bits`` differing bits) and by minwise bytes, first each
    text with the first one under its keys, then those that this leaves in different classes; each pair is
    verified on its whole texts. So a group of copies forms few pairs. Rows of one id and equal
    fingerprints are one text. Blank texts are alike; null ids get the class of a text with equal
    fingerprints, or null. An empty table gives no rows.
    """
    fps = stash(fingerprints(docs, id_col, text_col, words, wide=True))
    nodes = stash(fps.where("doc_id is not null").groupBy("fp", "sig").agg(F.min("doc_id").alias("node")))
    by_fp = stash(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    by_sig = stash(nodes.where("sig is not null").groupBy("sig").agg(F.min("node").alias("first")))
    wide = by_sig.select(F.col("first").alias("node"), "sig")
    index = stash(minwise_index(wide))

    def true(met: DataFrame) -> DataFrame:
        met = stash(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        ends = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).join(ends, "node", "left_semi")
        return stash(verified(met, stash(texts.groupBy("node").agg(F.min("text").alias("text"))), likeness, words))

    met = links(by_fp.withColumnRenamed("first", "node"), max_bits).unionByName(pairs_with_first(index, wide, likeness))
    for same, column in ((by_fp, "fp"), (by_sig, "sig")):
        met = met.unionByName(nodes.join(same, column).select(F.col("first").alias("a"), F.col("node").alias("b")))
    edges = true(met)
    parts = connected_components(edges)
    more = true(pairs_across(index, wide, parts, likeness))
    if not more.isEmpty():
        parts = connected_components(edges.unionByName(more))
    classes = stash(nodes.join(parts, "node", "left").select(F.col("fp").alias("f"), F.col("sig").alias("s"), F.coalesce("component", "node").alias("component_id")))
    return fps.join(classes, (F.col("fp") == F.col("f")) & F.col("sig").eqNullSafe(F.col("s")), "left").select("doc_id", "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
