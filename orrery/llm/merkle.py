"""Merkle manifest of a dataset, with an authentication path for every row.

Each group of rows (a language, say) is a binary tree over its rows' hashes, in the order of their ids;
the roots of the groups, in the order of the groups, are the leaves of one tree above. A node is the SHA-256
of its children's digests as hex text; a last node without a sibling is hashed alone.

Trees are cut into aligned blocks of 2^10 leaves. Going up, a block leaves its root, which is a leaf of
the next level of blocks, until every group has one node. Going down, each block traverses its leaves in order
after the fractal scheme of Jakobsson, Leighton, Micali and Szydlo: its height is cut into layers of subtrees
of height two; in each layer the existing subtree, which holds the nodes that the next paths need, is
kept, while the desired one to its right grows by two steps a leaf and takes its place in time. A block's rows come
sorted behind a header that holds the path from the block's root upwards, and each path is finished with it. So a
task holds one block, whatever the size of the tree, and only digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sha256, stash, table

#: A block has 2 to this power of leaves.
BLOCK_BITS = 10
#: Height of the subtrees that a traversal stacks.
LAYER = 2
STEPS = pa.struct([("left", pa.bool_()), ("sibling", pa.string())])


def node(*children: str) -> str:
    """The digest of a node: SHA-256 over its children's digests as hex text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height_of(n: int) -> int:
    """The height of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


class Subtree:
    """The nodes of heights ``low`` to ``high`` - 1 over the leaves from ``start``, grown in steps (treehash).

    ``nodes[t - low]`` are those of height t, from left to right; leaves beyond the last are none.
    """

    def __init__(self, leaves: list[str], start: int, low: int, high: int):
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]
        self.low, self.high, self.start = low, high, start
        self.steps = self._grow(leaves)

    def _keep(self, height: int, digest: str) -> tuple[int, str]:
        if self.low <= height < self.high:
            self.nodes[height - self.low].append(digest)
        return height, digest

    def _grow(self, leaves: list[str]) -> Iterator[None]:
        stack: list[tuple[int, str]] = []
        for i in range(self.start, min(len(leaves), self.start + (1 << self.high))):
            stack.append(self._keep(0, leaves[i]))
            yield
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                height, right = stack.pop()
                stack.append(self._keep(height + 1, node(stack.pop()[1], right)))
                yield
        while stack and stack[-1][0] < self.high:  # the right edge, up to the full height
            height, last = stack.pop()
            pair = (stack.pop()[1], last) if stack and stack[-1][0] == height else (last,)
            stack.append(self._keep(height + 1, node(*pair)))
            yield

    def grow(self, steps: int | None = None) -> Subtree:
        """By a number of steps, or to the end."""
        for _ in self.steps:
            if steps is not None and (steps := steps - 1) <= 0:
                break
        return self

    def sibling(self, leaf: int, height: int) -> tuple[bool, str | None]:
        """Whether the sibling on a leaf's path at this height stands left, and its digest, or None without one."""
        at = (leaf >> height) - (self.start >> height)
        row = self.nodes[height - self.low]
        return bool(at & 1), row[at ^ 1] if at ^ 1 < len(row) else None


def paths(leaves: list[str], height: int, layer: int = LAYER) -> Iterator[list[tuple[bool, str | None]]]:
    """The authentication path of each leaf in turn, in a tree of this height (fractal traversal)."""
    bounds = [(low, min(low + layer, height)) for low in range(0, height, layer)]
    existing = [Subtree(leaves, 0, low, high).grow() for low, high in bounds]
    desired = [Subtree(leaves, 1 << high, low, high) for low, high in bounds]
    for leaf in range(len(leaves)):
        for i, (low, high) in enumerate(bounds):
            if leaf and leaf % (1 << high) == 0:
                existing[i] = desired[i].grow()
                desired[i] = Subtree(leaves, leaf + (1 << high), low, high)
        yield [existing[t // layer].sibling(leaf, t) for t in range(height)]
        for subtree in desired:
            subtree.grow(2)


def block_root(leaves: list[str], height: int) -> str:
    """The digest at this height over a block's leaves."""
    for _ in range(height):
        leaves = [node(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0]


def runs(batches, begins) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows; ``begins(batch)`` says which rows begin one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(begins(batch))
        for low, high in zip([0, *starts], [*starts, len(batch)]):
            if held and low in starts:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their group from 0 by ``order`` (nulls first), and ``n``, the group's size.

    Ranges of the order are numbered each for itself; prefix sums over the ranges' sizes, of which there are
    few, do the rest. Rows alike in everything are dealt out by chance, as their order doesn't matter.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "chance"]]
    ranged = rows.withColumn("chance", F.rand(12)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("chance")
    ranged = stash(ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id() % (1 << 33)}))
    sizes = ranged.groupBy("part", group).agg(F.count("*").alias("size"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    before = F.sum("size").over(whole.orderBy("part")) - F.col("size") - F.col("first")
    bases = stash(sizes.select(F.col("part").alias("in_part"), F.col(group).alias("in_group"), before.alias("base"), F.sum("size").over(whole).alias("n")))
    found = ranged.join(bases, (F.col("part") == F.col("in_part")) & F.col(group).eqNullSafe(F.col("in_group")))
    return found.withColumn("pos", F.col("base") + F.col("row")).drop("part", "row", "base", "in_part", "in_group")


def _block(pos: str = "pos") -> Column:
    return F.shiftright(pos, BLOCK_BITS)


def roots_of_blocks(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (grp, pos, hash, n): a node for each block."""

    def fold(batches):
        for run in runs(batches, lambda b: b.column("pos").to_numpy() % (1 << BLOCK_BITS) == 0):
            n = run.column("n")[0].as_py()
            root = block_root(run.column("hash").to_pylist(), min(BLOCK_BITS, height_of(n)))
            pos = run.column("pos")[0].as_py() >> BLOCK_BITS
            yield pa.record_batch([run.column("grp")[:1], pa.array([pos]), pa.array([root]), pa.array([-(-n >> BLOCK_BITS)])], names=["grp", "pos", "hash", "n"])

    dealt = nodes.select("grp", "pos", "hash", "n").repartition("grp", _block()).sortWithinPartitions("grp", "pos")
    return dealt.mapInArrow(fold, "grp string, pos long, hash string, n long")


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (grp, pos, hash, n) and the levels of blocks above, up to one node for each group."""
    levels = [nodes]
    while True:
        levels.append(stash(roots_of_blocks(levels[-1])))
        if levels[-1].where("n > 1").isEmpty():
            return levels


def proofs_in_blocks(nodes: DataFrame, headers: DataFrame, schema: str = "") -> DataFrame:
    """``(grp, pos, proof, tops, ...)`` for ``nodes`` (grp, pos, hash, n, ...), the path to the root and its digests.

    ``headers`` (grp, pos, proof, tops): what the root of the block ``pos`` has. ``schema``: the further columns of nodes.
    """
    names = [c.split()[0] for c in schema.split(",") if c]

    def traverse(batches):
        for run in runs(batches, lambda b: b.column("pos").to_numpy() < 0):
            above, tops = run.column("proof")[0].as_py(), run.column("tops")[0]
            rows = run.slice(1)
            upper_left, upper = [s["left"] for s in above], [s["sibling"] for s in above]
            left, siblings = [], []
            height = min(BLOCK_BITS, height_of(rows.column("n")[0].as_py()))
            for path in paths(rows.column("hash").to_pylist(), height):
                left += [x for x, _ in path]
                left += upper_left
                siblings += [x for _, x in path]
                siblings += upper
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (height + len(above)))
            steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(siblings, pa.string())], fields=list(STEPS))
            columns = [rows.column("grp"), rows.column("pos"), pa.ListArray.from_arrays(ends, steps), pa.array([tops.as_py()] * len(rows), pa.list_(pa.string()))]
            yield pa.record_batch(columns + [rows.column(c) for c in names], names=["grp", "pos", "proof", "tops", *names])

    head = headers.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "proof", "tops")
    both = nodes.withColumn("block", _block()).unionByName(head, allowMissingColumns=True)
    dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    more = f", {schema}" if schema else ""
    return dealt.mapInArrow(traverse, f"grp string, pos long, proof array<struct<left:boolean,sibling:string>>, tops array<string>{more}")


def descended(levels: list[DataFrame], headers: DataFrame, schema: str = "") -> DataFrame:
    """Proofs of the lowest of ``levels``, from ``headers`` of the highest."""
    for level in levels[-2:0:-1]:
        headers = stash(proofs_in_blocks(level, headers))
    return proofs_in_blocks(levels[0], headers, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """``(doc_id, grp, leaf, claimed, subroot, root, proof)``, a row for each row of ``leaves`` (doc_id, grp, leaf, claimed).

    ``proof`` has a step for each level, from the leaf through the group's root to the dataset's: whether
    the sibling stands left, and its digest, or null where a node is hashed alone. ``claimed`` is any string
    that goes along. Leaves ascend by doc_id inside a group, a null id first; rows of one id (of a null id, too) by
    their leaf, so repeated rows have paths of their own. A null group is one group, the first. A
    single leaf is its group's root, a single group's root the root of all. An empty table gives no rows.
    """
    extra = "doc_id long, hash string, claimed string"
    low = levels_of(stash(placed(leaves.withColumnRenamed("leaf", "hash"), "grp", ["doc_id", "hash"])))
    tops = low[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    high = levels_of(stash(placed(tops, "grp", ["name"])))
    none = F.array().cast("array<struct<left:boolean,sibling:string>>")
    found = descended(high, high[-1].select("grp", "pos", none.alias("proof"), F.array("hash").alias("tops")), "name string, hash string")
    headers = stash(found.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "proof", F.concat(F.array("hash"), "tops").alias("tops")))
    rows = descended(low, headers, extra)
    return rows.select("doc_id", "grp", F.col("hash").alias("leaf"), "claimed", F.get("tops", F.lit(0)).alias("subroot"), F.get("tops", F.lit(1)).alias("root"), "proof")


def field(value: Column) -> Column:
    """A value as a leaf hashes it: its bytes in UTF-8 behind their count and a colon, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return sha256(F.concat(*map(field, values)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""

    def step(digest: Column, s: Column) -> Column:
        pair = F.when(s["left"], F.concat(s["sibling"], digest)).otherwise(F.concat(digest, s["sibling"]))
        return sha256(F.coalesce(pair, digest))

    return F.aggregate(proof, leaf, step)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of a row's id, the claimed leaf is that of a tampered row: n_chars one higher."""
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    leaf = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("grp"), leaf(n_chars).alias("leaf"), F.when(struck, leaf(n_chars + 1)).alias("claimed"))
    found = manifest(leaves).withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", sha256(F.array_join(F.col("proof")["sibling"], "")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: CRC-32 of the digits of a number, unsigned: one step for each bit.
CRC32_SQL = r"""xor(list_reduce(range(8 * length({0}::VARCHAR)), lambda a, i:
    xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr({0}::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) >> 1,
        (xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr({0}::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"""
_FIELDS = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "{n}::VARCHAR", "text"))

OP12_SQL = rf"""
WITH RECURSIVE hashed AS (SELECT doc_id, lang, sha256({_FIELDS.format(n="n_chars")}) AS leaf,
        CASE WHEN {CRC32_SQL.format("doc_id")} % 7 = 0 THEN sha256({_FIELDS.format(n="(n_chars::HUGEINT + 1)")}) END AS claimed FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM hashed),
nodes AS (
    SELECT lang, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM d
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subs AS (SELECT lang, level AS height, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, rank AS pos, subroot AS hash, count(*) OVER () AS n FROM subs
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT level AS height, hash AS root FROM tops WHERE n = 1),
low AS (SELECT d.id, l.level, CASE WHEN s.hash IS NULL THEN '-' WHEN (d.pos >> l.level) % 2 = 1 THEN 'l' || s.hash ELSE 'r' || s.hash END AS step
    FROM d JOIN subs u ON u.lang IS NOT DISTINCT FROM d.lang, unnest(range(u.height)) l(level)
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM d.lang AND s.level = l.level AND s.pos = xor(d.pos >> l.level, 1)),
high AS (SELECT u.rank, l.level, CASE WHEN s.hash IS NULL THEN '-' WHEN (u.rank >> l.level) % 2 = 1 THEN 'l' || s.hash ELSE 'r' || s.hash END AS step
    FROM subs u, root, unnest(range(root.height)) l(level) LEFT JOIN tops s ON s.level = l.level AND s.pos = xor(u.rank >> l.level, 1)),
low_steps AS (SELECT id, list(step ORDER BY level) AS steps FROM low GROUP BY id),
high_steps AS (SELECT rank, list(step ORDER BY level) AS steps FROM high GROUP BY rank),
proofs AS (SELECT d.doc_id, d.leaf, d.claimed, u.subroot, root.root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
    FROM d JOIN subs u ON u.lang IS NOT DISTINCT FROM d.lang CROSS JOIN root LEFT JOIN low_steps a ON a.id = d.id LEFT JOIN high_steps b ON b.rank = u.rank),
folds AS (SELECT *, list_reduce(steps, lambda a, s: CASE s[1] WHEN 'l' THEN sha256(s[2:] || a) WHEN 'r' THEN sha256(a || s[2:]) ELSE sha256(a) END,
    coalesce(claimed, leaf)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), 'string_agg', ''), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folds
"""
