"""Packing documents into fixed token windows: concatenate and cut, in two passes.

The first pass tokenises every document once and writes its ids beside the number of the
scan partition and the document's place in it; a partition's total is one row. Prefix sums
over the partitions' totals, and inside each partition over its documents, give every
document its offset in one endless run of tokens. The second pass reads the written ids
and cuts that run at the multiples of the window; a document that crosses a boundary
leaves one record for each window it touches.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table


#: Documents encoded at a time inside a task.
SLICE = 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def exact_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its token ids (unsigned 32-bit array), by the tokenizer file at ``path``.

    Where the same vocabulary lies beside it as ranks (``.tiktoken``), that faster encoder is
    used; texts that hold a special token's string, or that it can't take, go to the tokenizer
    itself, which is loaded only then. Both give the same ids.
    """

    def exact(text: str) -> np.ndarray:
        return np.array(exact_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")

    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens", [])]
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return exact

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return exact(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the encoder's own runtime, on some extreme texts; it can't be imported
                raise
            return exact(text)

    return encode


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, before, doc_id, n, ids)``: a document's ids (little-endian unsigned 32-bit, ``end_id``
    last), their number, its scan partition, and the tokens before it in there."""

    def batches(it):
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        run = 0
        for batch in it:
            for first in range(0, len(batch), SLICE):
                part = batch.slice(first, SLICE)
                ids = [np.concatenate([encode(x.as_py() or ""), end]).tobytes() for x in part.column(1)]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                before = run + np.cumsum(sizes) - sizes
                run += int(sizes.sum())
                yield pa.record_batch(
                    [part.column(2), pa.array(before), part.column(0), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["part", "before", "doc_id", "n", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(batches, "part int, before long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, window: int = 1024, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all documents into sequences of ``window`` tokens; a row for each piece.

    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: start is the piece's
    place in its document, offset that in its sequence, ids its tokens as little-endian
    unsigned 32-bit. Every sequence is full but the very last. A null or empty text is the
    end token alone; repeated rows and null ids are packed like any other; an empty table
    gives no rows. Which documents are neighbours follows the input's partitions.
    """
    tokens = stash(token_table(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each scan partition: few enough for a single task at any size of the corpus.
    # Written, so that its true size decides whether the join sends it to all executors.
    bases = stash(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")))
    return cut(tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("before")), window)


def cut(placed: DataFrame, window: int) -> DataFrame:
    """The pieces of documents whose offset ``at`` in the run of all tokens is known."""

    def batches(it):
        for batch in it:
            column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            at, n, ids = column("at"), column("n"), batch.column("ids")
            first = at // window
            pieces = (at + n - 1) // window - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low, high = np.maximum(sequence * window, at[doc]), np.minimum((sequence + 1) * window, (at + n)[doc])
            # pieces follow each other in the batch's own bytes: only their bounds are new
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
            bounds = np.append(ends[:-1][doc] + 4 * (low - at[doc]), ends[-1]).astype(np.int32)
            cut_ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), ids.buffers()[2]])
            numbers = [pa.array(x) for x in (low - at[doc], high - low, n[doc], sequence, low - sequence * window)]
            start, length, total, sequence_id, offset = numbers
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(doc)), start, length, cut_ids, total, sequence_id, offset],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "at", "n", "ids").mapInArrow(batches, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
