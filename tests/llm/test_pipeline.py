"""The pipeline's stages, each against a plain-Python version on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
from orrery.llm import langid, packing
from orrery.llm.common import stash, table
from pyspark.sql import functions as F

from .fixtures import written
from .test_documents import brute_targets, likeness, shingle_sets

SF = "/root/testdata/sf0.001"
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages(spark):
    docs = table(spark, SF, "documents").select("*", F.lit("kept").alias("extra"))
    columns = docs.columns
    first = stash(stage("language_id")(spark, docs, SF))
    model = langid.train(docs)
    want = {r.doc_id: langid.judge_text(model, r.text) for r in docs.collect()}
    assert first.columns == columns
    assert {r.doc_id: r.lang for r in first.collect()} == {i: x[0] for i, x in want.items() if x[0] != "und" and x[1] >= cp.MIN_SCORE}

    second = stash(stage("line_dedup")(spark, first, SF))
    owner, key = {}, lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    rows = sorted(first.collect(), key=lambda r: r.doc_id)
    for r in rows:
        for k in map(key, r.text.split("\n")):
            if len(k) >= 10:
                owner.setdefault(k, r.doc_id)
    kept = {r.doc_id: "\n".join(x for x in r.text.split("\n") if owner.get(key(x), r.doc_id) == r.doc_id) for r in rows}
    kept = {r.doc_id: kept[r.doc_id] for r in rows if kept[r.doc_id] == r.text or words(kept[r.doc_id])}
    assert second.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in second.collect()} == {i: (t, len(t)) for i, t in kept.items()}

    third = stash(stage("simhash_dedup")(spark, second, SF))
    sets = {i: shingle_sets(t) for i, t in kept.items()}
    first_of = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and likeness(sets[i], sets[j]) >= 0.8:
                low, high = sorted((first_of[i], first_of[j]))
                first_of = {k: low if v == high else v for k, v in first_of.items()}
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(i for i, c in first_of.items() if i == c)

    fourth = stash(stage("mixing")(spark, third, SF))
    assert fourth.columns == columns
    texts, sizes, taken, parts = {r.doc_id: r for r in third.collect()}, defaultdict(int), defaultdict(int), Counter()
    for r in texts.values():
        sizes[r.source] += len(words(r.text))
    copies = Counter()
    for r in fourth.collect():
        whole = texts[r.doc_id]
        taken[r.source] += len(words(r.text))
        copies[r.doc_id] += len(words(r.text))
        assert whole.text == r.text or (whole.text.startswith(r.text) and r.n_chars == len(r.text))
        parts[r.source] += whole.text != r.text
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 and parts[s] <= 1
    assert all(n <= 2 * len(words(texts[i].text)) for i, n in copies.items())

    fifth = stage("packing")(spark, fourth, SF).toPandas().sort_values(["sequence_id", "offset"])
    stream = np.concatenate([np.frombuffer(x, "<u4") for x in fifth.ids])
    encode = packing.encoder(packing.default_tokenizer())
    assert Counter(np.split(stream, np.flatnonzero(stream == 0) + 1)[i].tobytes() for i in range(int((stream == 0).sum()))) == Counter(
        np.array([*encode(r.text), 0], "<u4").tobytes() for r in fourth.collect()
    )


def test_stages_on_odd_rows_and_names(spark, tmp_path):
    """Each stage alone: nulls, blanks, repeated rows and columns of any name; the values of others stay."""
    docs = table(spark, written(spark, tmp_path / "odd"), "documents")
    extra = ["score", "lang_pred", "judged", "kept_text", "n_dropped", "n_lines", "first", "rows", "hash", "taken", "size", "row_hash", "alike", "copy", "_row", "given_1"]
    marked = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    for name, f in cp.STAGES[:-1]:
        got = f(spark, marked, "")
        assert got.columns == marked.columns
        rows = got.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in extra)
        plain = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in f(spark, docs, "").collect())
        assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows) == plain
        assert f(spark, docs.limit(0), "").count() == 0
    assert cp.pack_sequences(spark, marked, "").where("start = 0").count() == docs.count()
    kept = [(r.doc_id, r.text) for r in stage("simhash_dedup")(spark, docs, "").collect()]
    assert Counter(i for i, _ in kept) == Counter([0, 2, 5, 6, 7, 9, 120, None])
    mixed = stage("mixing")(spark, docs, "").where("doc_id = 9").collect()  # a row twice: both share what the source takes
    sizes = [sum(len(words(r.text)) for r in mixed)]
    assert sizes[0] <= 4 * 3001


def test_run_on_odd_rows(spark, tmp_path):
    assert cp.run(spark, written(spark, tmp_path / "odd")).where("start = 0").count() > 0
    assert cp.run(spark, written(spark, tmp_path / "none", [])).count() == 0
