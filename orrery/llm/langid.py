"""Language identification by bit-sliced Bloom filters over character n-grams.

Every language is a bit; 64 of them make a word, and there are as many words as it takes. For
each, a table of ``cells`` bit masks holds one Bloom filter for each language, bit-sliced: mask j
carries position j of all its filters at once. Looking an n-gram up
is a bitwise AND of ``probes`` masks and returns the languages that hold it, all in one go.
A text's n-grams give a popcount for each language; the hits that a filter's own fill
makes by chance are taken out, and the language with the most of the rest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sheltered, table

#: Code points of a text that are looked at together; what they leave over is carried on.
WINDOW = 1 << 19
#: Bits of a hash that one probe may take, and so the most cells of a filter as a power of two.
PROBE_BITS = 21
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class LanguageModel:
    """``masks``: the bit-sliced filters, a table for each 64 languages (one table may come bare);
    ``fill``: the chance of a false hit, by language."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray
    n: int
    probes: int

    def hits(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """Which of a word's 64 languages hold each n-gram, as bit masks."""
        masks = self.masks if self.masks.ndim == 1 else self.masks[word]
        at = np.uint64(len(masks) - 1)
        found = masks[grams & at]
        for i in range(1, self.probes):
            found &= masks[(grams >> np.uint64(PROBE_BITS * i)) & at]
        return found

    def scores(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The share of n-grams each language truly holds: popcounts without the false hits."""
        share = counts / np.maximum(total, 1)[:, None]
        return np.clip((share - self.fill) / np.maximum(1 - self.fill, 1e-9), 0, 1)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for every n-gram of a run of code points."""
    if len(points) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(points) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ points[i : len(points) - n + 1 + i].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def letter_runs(text: str) -> Iterator[np.ndarray]:
    """A text's lower-cased letters as code points, window by window; every run of others is one space, also at both ends."""
    after_letter = True
    for i in range(0, len(text), WINDOW):
        part = " " * (i == 0) + text[i : i + WINDOW].lower() + " " * (i + WINDOW >= len(text))
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters(points)
        keep = letter | np.concatenate([[after_letter], letter[:-1]])
        after_letter = bool(letter[-1])
        points = np.where(points == 0x3C2, 0x3C3, points)  # a final sigma hangs on what follows, perhaps in the next window
        yield np.where(letter, points, 32)[keep]


def gram_runs(text: str, n: int) -> Iterator[np.ndarray]:
    """The hashes of all n-grams of a whole text, each once, window by window."""
    tail = np.zeros(0, dtype=np.int64)
    for points in letter_runs(text):
        points = np.concatenate([tail, points])
        yield gram_hashes(points, n)
        tail = points[max(0, len(points) - n + 1) :]


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters: ASCII by range, others one by one but once each."""
    low = points | 32
    found = (low >= 97) & (low <= 122) & (points < 128)
    wide = points >= 128
    if wide.any():
        kinds, inverse = np.unique(points[wide], return_inverse=True)
        found[wide] = np.fromiter((chr(k).isalpha() for k in kinds), dtype=bool, count=len(kinds))[inverse]
    return found


def _count_grams(sample: DataFrame, n: int) -> DataFrame:
    """``(lang, gram, count)`` for each language's n-grams in the sample, summed by Spark."""

    def batches(it):
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run in gram_runs(text, n):
                    grams, counts = np.unique(run, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "count"])

    return sample.mapInArrow(batches, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def held_out(id_col: str = "doc_id"):
    """Whether CRC-32 of the id as text, modulo 5, is 0: such documents are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 3, max_docs: int = 1000,
    coverage: float = 0.98, probes: int = 3,
) -> LanguageModel:
    """Learn from labelled documents that are not held out.

    ``max_docs`` bounds the labelled sample of a language (in expectation, chosen by a hash of
    the id; a documented bound of the fit). A language keeps its most frequent n-grams, as many
    as make up the share ``coverage`` of its sample, however many those are; the filters have 32
    cells or more for each n-gram of the language that keeps most, up to 2**21. All labels are
    learnt. Rows without id, text or label are left out.
    """
    if not 1 <= probes * PROBE_BITS <= 64:
        raise ValueError(f"probes must be from 1 to {64 // PROBE_BITS}")
    s = Sheltered(docs)
    usable = s.rows.select(s[id_col].alias("id"), s[text_col].cast("string").alias("text"), s[lang_col].cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    kept: dict[str, np.ndarray] = {}
    if languages:
        shares = [(k, int(2**40 * min(1, max_docs / sizes[k]))) for k in languages]
        share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long"))  # a row for each label
        picked = usable.join(share, "lang").where(F.pmod(F.xxhash64("id"), F.lit(2**40)) < F.col("share")).where("text is not null")
        own = Window.partitionBy("lang")
        before = F.sum("count").over(own.orderBy(F.desc("count"), "gram").rowsBetween(Window.unboundedPreceding, -1))
        ranked = _count_grams(picked.select("lang", "text"), n).select("lang", "gram", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(own).alias("total"))
        found = ranked.where(F.col("before") < F.col("total") * coverage).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
        kept = {r["lang"]: np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in found.collect()}
    most = max(map(len, kept.values()), default=0)
    cells = 1 << min(PROBE_BITS, max(16, (32 * most).bit_length()))
    masks, fill = np.zeros((max(1, -(-len(languages) // 64)), cells), dtype=np.uint64), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        bit = np.uint64(1 << k % 64)
        for i in range(probes):
            masks[k // 64, ((kept.get(lang, np.zeros(0, np.uint64)) >> np.uint64(PROBE_BITS * i)) & np.uint64(cells - 1)).astype(np.int64)] |= bit
        fill[k] = float(((masks[k // 64] & bit) != 0).mean()) ** probes
    return LanguageModel(languages, masks, fill, n, probes)


def popcounts(model: LanguageModel, text: str) -> tuple[np.ndarray, int]:
    """How many of a whole text's n-grams each language holds, and how many there are."""
    counts, total = np.zeros(len(model.languages), dtype=np.int64), 0
    for grams in gram_runs(text, model.n):
        total += len(grams)
        for first in range(0, len(counts), 64):
            found = model.hits(grams, first // 64)
            for k in range(min(64, len(counts) - first)):
                counts[first + k] += int(((found >> np.uint64(k)) & np.uint64(1)).sum())
    return counts, total


def judge_text(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The language of a whole text and its score; ``("und", 0.0)`` if there is none to tell."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts, total = popcounts(model, text)
    row = model.scores(counts[None, :], np.array([total]))[0]
    best = int(row.argmax())
    return model.languages[best], float(row[best])


def classify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, ``lang_pred`` and ``score``, in place of any of these names.

    ``und`` with score 0 if the text is null or has no letter, or if no language was
    learnt. The score is the share of the text's n-grams that the language holds. Ties go to
    the language first in order. Every row is judged by its own whole text; repeated rows
    alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [judge_text(shared.value, x) for x in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    # a deterministic function would run twice where its result is filtered
    s = Sheltered(docs)
    judged = s.rows.withColumn("judged", judge.asNondeterministic()(s[text_col].cast("string")))
    return judged.select(*s.back("lang_pred", "score"), "judged.lang_pred", "judged.score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = classify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
