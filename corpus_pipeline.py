"""A corpus pipeline of five stages, each one operator of the library at work on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import langid, linededup, mixing, packing, simhash
from orrery.llm.common import WORD, Sheltered, bound_batches, stash, table, text_of

#: Least share of a document's n-grams that its language must hold; tables of symbols and the like stay below.
MIN_SCORE = 0.1

# Every stage takes columns of any names beside doc_id, text, lang, source and n_chars, and returns the
# columns it was given, in their order. No stage fails on nulls, or on a table without rows (it gives none).


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learnt, and set lang to it.

    Null, empty and letterless texts go. Repeated rows are judged alike; null ids and labels are
    not learnt from but judged.
    """
    bound_batches(spark)
    model = langid.train(docs)
    s = Sheltered(docs)
    judged = langid.classify(s.rows, model, s.at("doc_id"), s.at("text")).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return s.with_columns(judged, lang=F.col("lang_pred"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds, and documents of which nothing is left.

    Null, empty and blank texts have nothing to drop and stay. Repeated rows share an id and keep
    their lines alike; null ids come after all others.
    """
    s = Sheltered(docs)
    found = linededup.drop_repeated_lines(s.rows, s.at("doc_id"), s.at("text"))
    found = found.withColumn("kept_text", F.explode(F.array("kept_text")))  # joined once, not once for each use
    found = found.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(WORD))
    return s.with_columns(found, text=F.when(F.col("n_dropped") == 0, s["text"]).otherwise(F.col("kept_text")), n_chars=F.char_length("kept_text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id in each group of texts that share 0.8 of their five-word shingles or more.

    Null, empty and blank texts are one group. Of rows alike in id and text one stays; rows of one
    id with different texts stay or go together. A null id stays only where no document
    with an id has the same text.
    """
    s = Sheltered(docs)
    classes = stash(simhash.alike(s.rows, s.at("doc_id"), s.at("text")))
    firsts = classes.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    firsts = stash(firsts.withColumnRenamed("doc_id", "first"))
    kept = s.rows.join(firsts, s["doc_id"].eqNullSafe(F.col("first")))
    once = kept.where("rows = 1").select(*s.back())
    several = kept.where("rows > 1").withColumn("hash", F.xxhash64(text_of(s["text"]))).dropDuplicates([s.at("doc_id"), "hash"])
    return once.unionByName(several.select(*s.back()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target asks; the last repetition may be a part.

    Texts without words are taken no times and go. Rows alike in id, source and text share what the mix
    takes of them, each as many words as the next to within one. A null source is a source.
    """
    s = Sheltered(docs)
    taken = mixing.mix(s.rows, s.at("doc_id"), s.at("text"), s.at("source")).where("size > 0")
    taken = taken.groupBy("doc_id", "source", "row_hash").agg(F.min("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("alike"))
    same = s["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("row_hash")) & s["source"].eqNullSafe(F.col("source"))
    rows = s.rows.withColumn("hash", F.xxhash64(text_of(s["text"]))).join(taken, same)
    single, several = rows.where("alike = 1"), rows.where("alike > 1")
    number = F.row_number().over(Window.partitionBy(s["doc_id"], "hash", s["source"]).orderBy(F.lit(0)))
    share = F.floor(F.col("taken") / F.col("alike")) + (number <= F.col("taken") % F.col("alike")).cast("long")
    rows = single.unionByName(several.withColumn("taken", share)).where("taken > 0")
    rest = F.col("taken") % F.col("size")
    part = F.regexp_substr(s["text"], F.concat(F.lit(f"^(?:[\\x20\\x09-\\x0D]*+{WORD}+){{"), rest, F.lit("}+")))  # its first words
    texts = F.concat(F.array_repeat(s["text"], (F.col("taken") / F.col("size")).cast("int")), F.when(rest > 0, F.array(part)).otherwise(F.array()))
    rows = rows.withColumn("copy", F.explode(texts))
    return s.with_columns(rows, text=F.col("copy"), n_chars=F.char_length("copy").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into sequences of 1024 tokens; a row for each piece, with its tokens.

    Null and empty texts are an end token alone; repeated rows and null ids are packed like any other.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and token ids are beyond SQL; tests/llm compares run() with a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
