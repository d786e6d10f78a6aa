"""Prefix tries of conversations, by mergeable partial tries.

A node stands for a distinct sequence of first turns and is keyed by a hash that chains its turns' digests.
Conversations are dealt out by ranges of their ids; each partition walks its turns in order and combines
them into a table of nodes of its own: members, least member and the ids of conversations that end there. Partial
tables are merged by key in rounds, ``FAN`` partitions to one each round, so that a node which all of them hold
(the root, a common first turn) never meets more than a few of its rows in one task. A node's ids are runs in
rising order, since partitions are ranges of ids; runs are joined up to ``RUN`` ids a row. Sums over subtrees roll
up from the leaves by doubling: after k rounds a node has the sum of the 2^k levels below, and takes what its
descendants 2^k levels down have, so rounds grow with the logarithm of the depth.

Turns travel as digests: texts are never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, sha256, stash, table, text_of
from .merkle import CRC32_SQL

#: Partial tables merged into one in each round.
FAN = 32
#: Most ids in a row of a node's ends.
RUN = 1024
#: Nodes, or conversations, that a partition combines before it passes them on.
HELD = 1 << 16
ROOT = b"\0" * 16
PARTIAL = "key binary, parent binary, depth long, words long, part long, n_convs long, low long, ends array<long>"


def turn_columns(role: str, text: str) -> tuple[Column, Column]:
    """A turn's digest (the role's length keeps role and text apart) and the words of its text."""
    said = F.concat(F.char_length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text))
    return F.unhex(sha256(said)), F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, digest, words)`` of rows of turns; rows without an id belong to no conversation."""
    digest, words = turn_columns(role_col, text_col)
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), digest.alias("digest"), words.alias("words"))
    return rows.where("conv_id is not null")


def with_heads(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``(conv_id, own, turn, role, digest, words, skip)``: rows of turns, in which conversations begin with turns of another.

    The first h turns of conversation c - c % ``every`` stand before c's own (``own`` 0 and 1), of which ``skip`` = h are to
    be left out; h is the CRC-32 of c's decimal id modulo ``most``. Only the first ``most`` - 1 turns of those conversations are gathered.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order_of(F.col)))
    firsts = rows.where(F.col("conv_id") % every == 0).withColumn("place", place).where(F.col("place") < most)
    heads = firsts.select(F.col("conv_id").alias("base"), "turn", "role", "digest", "words", "place")
    takers = rows.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("skip")).where("skip > 0")
    begun = takers.join(heads, "base").where("place <= skip").select("conv_id", F.lit(0).alias("own"), "turn", "role", "digest", "words", "skip")
    return rows.select("conv_id", F.lit(1).alias("own"), "turn", "role", "digest", "words", h.alias("skip")).unionByName(begun)


def order_of(col) -> list[Column]:
    """The order of a conversation's turns: by number, null first; ties by role, then by the digest of the turn."""
    return [col("turn").asc_nulls_first(), col("role"), col("digest")]


def partial_tries(rows: DataFrame) -> DataFrame:
    """A table of nodes (:data:`PARTIAL`) for each partition of ``rows``, as :func:`with_heads` gives them.

    Every partition has a range of ids; a conversation is walked turn by turn as its rows pass, so a long one needs no more memory.
    """

    def walk(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}  # key: parent, depth, words, members, least member, ends

        def table_of_nodes():
            found = [(k, p, d, w, part, n if at == 0 else 0, low, ends[at : at + RUN]) for k, (p, d, w, n, low, ends) in nodes.items() for at in range(0, max(len(ends), 1), RUN)]
            nodes.clear()
            for i in range(0, len(found), 1 << 13):
                columns = zip(*found[i : i + (1 << 13)])
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, KINDS)], names=NAMES)

        def visit(members: int) -> list:
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = [parent, depth, words, 0, conv, []]
            node[3] += members
            return node

        conv = key = parent = None
        own = depth = words = ended = 0
        for batch in batches:
            for c, mine, digest, said, skip in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if c != conv:
                    if conv is not None:
                        visit(0)[5].append(conv)
                        ended += 1
                    if ended > HELD:
                        yield from table_of_nodes()
                        ended = 0
                    conv, key, parent, depth, words, own = c, ROOT, None, 0, 0, 0
                    visit(1)
                own += mine
                if mine and own <= skip:
                    continue
                parent, key, depth, words = key, hashlib.sha256(key + digest).digest()[:16], depth + 1, said
                visit(1)
                if len(nodes) > HELD:
                    yield from table_of_nodes()
        if conv is not None:
            visit(0)[5].append(conv)
        if nodes:
            yield from table_of_nodes()

    dealt = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "own", *order_of(F.col))
    return dealt.select("conv_id", "own", "digest", "words", "skip").mapInArrow(walk, PARTIAL)


NAMES = [c.split()[0] for c in PARTIAL.split(", ")]
KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int64())]


def merged(partial: DataFrame, last: bool = False) -> DataFrame:
    """Partial tables with those of ``FAN`` neighbouring parts as one; in the ``last`` round all that are left, with ``ends_sha256``.

    Rows pass in the order of their ids, and at most ``RUN`` ids of a node are held. Sums stand in a node's last row.
    """

    def fold(batches):
        out: list[tuple] = []
        node: list | None = None

        def flushed():
            columns = zip(*out)
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(columns, [*KINDS, pa.string()])], names=[*NAMES, "ends_sha256"])
            out.clear()
            return batch if last else batch.select(NAMES)

        def emit(final: bool):
            key, part, parent, depth, words, n, low, ends, digest = node
            out.append((key, parent, depth, words, part, n if final else 0, low, ends, digest.hexdigest() if final else None))

        for batch in batches:
            for key, parent, depth, words, part, n, low, ends in zip(*(x.to_pylist() for x in batch.columns)):
                if node is None or node[0] != key or node[1] != part:
                    if node:
                        emit(True)
                    node = [key, part, parent, depth, words, 0, low, [], hashlib.sha256()]
                    begun = False
                node[5] += n
                node[6] = min(node[6], low)
                if last and ends:
                    node[8].update(("," * begun + ",".join(map(str, ends))).encode())
                    begun = True
                if len(node[7]) + len(ends) > RUN:
                    emit(False)
                    node[7] = ends
                else:
                    node[7] = node[7] + ends
                if len(out) >= 1 << 12:
                    yield flushed()
        if node:
            emit(True)
        if out:
            yield flushed()

    part = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN)
    rows = partial.withColumn("begin", F.get("ends", F.lit(0))).withColumn("part", part)
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "begin").select(*NAMES)
    return dealt.mapInArrow(fold, PARTIAL + ", ends_sha256 string" * last)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie over conversations given as :func:`with_heads` gives them, or with own = 1 and skip = 0.

    ``(key, parent, depth, words, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: ``words`` are
    those of the node's last turn, ``conv_id`` is the least member; the others as in the contract of op13. Conversations without any
    turn left are members of the root; without any conversation there are no nodes.
    """
    partial = stash(partial_tries(stash(rows)))
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN:
        partial, parts = stash(merged(partial)), -(-parts // FAN)
    merged_rows = stash(merged(partial, last=True))
    return rolled_up(merged_rows.where("ends_sha256 is not null").drop("ends", "part").withColumnRenamed("low", "conv_id"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """The nodes with their parents' ids, children, leaves and saved tokens below."""
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("parent").alias("up"))
    found = nodes.join(children, "key", "left").join(up, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    found = stash(found.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    # n_leaves and saved_tokens: of the levels 0 to reach - 1 below; up: the ancestor 2 * reach levels above, once over is summed
    sums = found.select("key", "depth", F.col("parent").alias("over"), "up", "n_leaves", "saved_tokens")
    deepest, reach = found.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        below = sums.where("over is not null").groupBy(F.col("over").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
        summed = sums.join(below, "key", "left").select("key", "depth", F.col("up").alias("over"), total("n_leaves", "more_leaves"), total("saved_tokens", "more_tokens"))
        reach *= 2
        if reach <= deepest:
            summed = stash(summed)
            further = summed.select(F.col("key").alias("over"), F.col("over").alias("up"))
            sums = stash(summed.join(further, "over", "left"))
        else:
            sums = summed
    return found.drop("n_leaves", "saved_tokens", "up").join(sums.select("key", "n_leaves", "saved_tokens"), "key")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(with_heads(digests(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = rf"""
WITH rows AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {CRC32_SQL.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM rows)),
rebuilt AS (
    SELECT c.conv_id, 0 AS own, r.place, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.conv_id - c.conv_id % 20 AND r.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, r.place, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.conv_id AND r.place > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, length(role) || ':' || role || text AS said,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (
    SELECT conv_id, depth, sha256(list(sha256(said)) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR) AS node, words,
        depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM turns
    UNION ALL
    SELECT conv_id, 0, 'root', 0, conv_id NOT IN (SELECT conv_id FROM turns) FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths),
nodes AS (SELECT node, any_value(parent) AS parent, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM steps GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
valued AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node),
sums AS (SELECT above, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT DISTINCT a.node AS above, b.node, v.n_children, (v.n_convs - 1) * v.words AS saved
        FROM steps a JOIN steps b ON b.conv_id = a.conv_id AND b.depth >= a.depth JOIN valued v ON v.node = b.node) GROUP BY above)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v LEFT JOIN nodes p ON p.node = v.parent JOIN sums s ON s.above = v.node
"""
