"""Operators on documents against plain-Python versions, on odd rows and on the small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from orrery.llm import langid, linededup, mixing, packing, pii, simhash, sketches
from orrery.llm.common import table
from pyspark.sql import functions as F

from .fixtures import TEXTS, frame, rows_of, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("none"), [])


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def docs_of(spark, d):
    return [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]


# --- 1: personal data -------------------------------------------------------------------

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_of(text):
    out = []
    for kind, rx in RX.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.mark.parametrize("where", ["odd", "none", SF])
def test_pii_base_spans(spark, where, request):
    d = where if where.startswith("/") else request.getfixturevalue(where)
    want = sorted((str(i), sha(",".join(base_of(t))), *(sum(x.startswith(k) for x in base_of(t)) for k in RX)) for i, t in docs_of(spark, d))
    got = pii.op1(spark, d).collect()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    texts = Counter((i, ",".join(base_of(t))) for i, t in docs_of(spark, d))
    for r in got:
        assert any(i == r.doc_id and set(filter(None, b.split(","))) <= set(r.spans.split(",")) for i, b in texts)


def test_pii_adds_likely_spans_only(spark):
    rows = [
        (1, "please contact me: jane.doe (at) mailbox (dot) org soon"),
        (2, "call 415-555-2671 today"),
        (3, "we met at the dot of noon, order 2024-11-05 and isbn 1234 5678 1234 5678"),
        (4, "nothing of note at all"),
        (5, None),
    ]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("out", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert got[1].out == "please contact me: [EMAIL] soon"
    assert got[2].out == "call [PHONE] today"
    assert not got[3].spans and not got[4].spans and not got[5].spans


def test_pii_long_text(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 50_000 + "x@y.z " * 200
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n")).first()
    assert row.n >= 200


def test_pii_many_spans_in_one_text(spark):
    text = "10.0.0.1 and 415-555-2671 call; " * 20_000
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("base"), F.size("spans").alias("all")).first()
    assert row.base == 20_000 and row.all == 40_000


PATTERNS = {
    "has_at_sign": "@", "bracketed_at": r"[(\[{]\x20?at\x20?[)\]}]|&#64;", "bracketed_dot": r"[(\[{]\x20?dot\x20?[)\]}]", "spelled_at": r"\x20at\x20", "spelled_dot": r"\x20dot\x20",
    "known_ending": r"(?i)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu)$", "short_ending": r"[.\x20)\]}][A-Za-z]{2,6}$", "four_fours": r"^[0-9]{4}(?:[^0-9][0-9]{4}){3}$",
    "in_brackets": r"^\(|^00[0-9]{1,3}[\x20.-]?\(", "three_three_four": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", "leading_zero": r"^\(?0",
    "looks_like_date": r"^(?:19|20)[0-9]{2}[\x20.-]|[\x20.-](?:19|20)[0-9]{2}$", "hex_groups": r"^(?:[0-9A-Fa-f]{1,4}:){7}",
    "bracketed_octets": r"^O(?:\[\.\]O){3}$".replace("O", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"),
}
CONTEXTS = {
    "word_mail": r"(?i)e-?mail|contact|write|reach|adress|correo|courriel", "word_phone": r"(?i)(?<![a-z0-9])(?:tel|phone|call|fax|mobile|cell|ring|telefon|telephone)",
    "word_card": r"(?i)card|visa|credit|debit|payment|karte|carte|tarjeta", "word_host": r"(?i)(?<![a-z0-9])ip(?![a-z0-9])|host|server|addr|client|peer|login",
    "word_other": r"(?i)isbn|version|serial|order|invoice|page|chapter|section|part|model|sku|ref|id(?![a-z0-9])|no\.|grid|hash|key",
}


def features_of(m, before, after):
    d = re.sub("[^0-9]", "", m)
    special = {
        "luhn": bool(d) and len(d) <= 64 and luhn(d), "one_separator": len(set(re.findall("[^0-9A-Fa-f]", m))) <= 1, "ten_digits": len(d) == 10, "phone_digits": 9 <= len(d) <= 15,
        "number_near": bool(re.search("[0-9][^A-Za-z]{0,3}$", before) or re.search("^[^A-Za-z]{0,3}[0-9]", after)),
    }
    bits = 0
    for i, (name, _) in enumerate(pii.FEATURES):
        has = special[name] if name in special else re.search(PATTERNS[name], m) if name in PATTERNS else re.search(CONTEXTS[name], before)
        bits |= bool(has) << i
    return bits


def all_spans_of(text, models, thresholds):
    base = [(list(RX).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in base_of(text))]
    asked = []
    for k, kind in enumerate(RX):
        for m in re.finditer(pii.PROPOSE[kind], text or ""):
            p = models[k].probability(features_of(m.group(), text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 32]))
            if p >= thresholds[k] and p > 0:
                asked.append((-p, k, m.start(), m.end()))
    kept = list(base)
    for _, k, s, e in sorted(asked):
        if all(e <= s2 or e2 <= s for _, s2, e2 in kept):
            kept.append((k, s, e))
    return ",".join(f"{list(RX)[k]}:{s}:{e}" for k, s, e in sorted(kept))


def test_pii_added_spans(spark, odd):
    models, thresholds = pii.train(spark)
    extra = ["call 00415 555 2671 or (415) 555-2671-10.0.0.1, visa 4539.1488.0343.6467", "jane.doe at mail dot org 415-555-2671@x.org", "::1 1:2:3:4:5:6:7:8 host 1[.]2[.]3[.]4 a(at)b(dot)org"]
    docs = docs_of(spark, odd) + docs_of(spark, SF) + list(enumerate(extra, 5000)) + [(6000 + i, e["text"]) for i, e in enumerate(pii.examples(400, seed=99))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = pii.detect(df, model=(models, thresholds)).select("doc_id", "text", pii.spell(F.col("spans")).alias("s")).collect()
    want = Counter((i, t, all_spans_of(t, models, thresholds)) for i, t in docs)
    assert Counter((r.doc_id, r.text, r.s) for r in got) == want
    examples = pii.examples(400, seed=99)
    added = {r.doc_id - 6000: r.s for r in got if r.doc_id is not None and r.doc_id >= 6000}
    hit = [bool(added[i]) for i in range(400)]
    true = sum(h for h, e in zip(hit, examples) if e["y"])
    assert true >= 0.85 * sum(e["y"] for e in examples) and true >= 0.95 * sum(hit)


# --- 4: sketches ------------------------------------------------------------------------


@pytest.mark.parametrize("where", ["odd", "none", SF])
def test_sketch_query(spark, where, request):
    d = where if where.startswith("/") else request.getfixturevalue(where)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    docs = sorted(((i, t or "") for i, t in docs_of(spark, d)), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    own = {t: brute_sketch(t) for _, t in docs}
    want = []
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        changed = brute_sketch(edited)
        near = [round(brute_resemblance(own[t], x), 9) for x in (changed, own[n])]
        want.append((str(i), len(t), sha(edited), " ".join(map(str, own[t])), " ".join(map(str, changed)), *near))
    got = sketches.op4(spark, d).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def chained(*hashes: int) -> int:
    """XXH64 of numbers, each seeded by the hash of those before."""
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def brute_sketch(text, k=128):
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    two = [chained(a, b) for a, b in zip(w, w[1:])]
    four = [chained(a, b) for a, b in zip(two, two[2:])]
    five = [chained(a, b) for a, b in zip(w, four[1:])]
    return sorted({h >> 16 for h in (five if len(w) >= 5 else [chained(*w)] if w else [])})[:k]


def brute_resemblance(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def test_followers_of_scattered_and_repeated_ids(spark):
    ids = [i << 40 for i in range(-50, 50)] + [7] * 60 + [None] * 80 + [3, 4, 5]
    rows = [(i, f"t{k}" if k % 7 else "same", k) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket long").withColumn("dealt", F.lit(1))
    got = sketches.with_next(docs, ["text"]).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "bucket", "dealt", "next_text"}
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = Counter((r[0], r[1], s[1]) for r, s in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want and sorted(r.bucket for r in got) == list(range(len(ids)))


def test_any_number_of_words(spark):
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(words[:n]),) for n in (0, 1, 3, 7, 8, 40)], "t string")
    for k in (1, 2, 3, 6, 7, 8):
        sizes = [r.n for r in df.select(F.size(sketches.sketch(F.col("t"), 128, k)).alias("n")).collect()]
        assert sizes == [0, 1, *[max(1, n - k + 1) for n in (3, 7, 8, 40)]]


def test_sketch_estimates(spark):
    a = [f"w{i}" for i in range(2000)]
    b = a[:1500] + [f"v{i}" for i in range(500)]
    df = spark.createDataFrame([(1, " ".join(a), " ".join(b))], "g long, a string, b string")
    s = df.select("g", sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    r = s.select(sketches.resemblance(F.col("a"), F.col("b")).alias("j"), sketches.containment(F.col("a"), F.col("b")).alias("c"), sketches.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.j - 0.6) < 0.15 and abs(r.c - 0.75) < 0.2 and abs(r.n / 1996 - 1) < 0.3
    parts = spark.createDataFrame([(1, " ".join(a[i : i + 24])) for i in range(0, 1980, 20)], "g long, t string").select("g", sketches.sketch(F.col("t")).alias("s"))
    whole = sketches.merge_by(parts, "g", "s", fan_in=8).first().s
    direct = df.select(sketches.sketch(F.concat_ws(" ", F.slice(F.split("a", " "), 1, 1984))).alias("s")).first().s
    assert whole == direct


# --- 5: simhash -------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=3):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, f in zip(ids, fps):
        for j, g in zip(ids, fps):
            if i < j and (f ^ g).bit_count() <= bits:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("where", ["odd", "none", SF])
def test_simhash_query(spark, where, request):
    d = where if where.startswith("/") else request.getfixturevalue(where)
    docs = [(i, t) for i, t in docs_of(spark, d)]
    fps = {(i, t): brute_simhash(t) for i, t in docs}
    whole = sorted({i for i, _ in docs if i is not None})
    comp = brute_components(whole, [fps[next(x for x in docs if x[0] == i)] for i in whole])
    got = simhash.op5(spark, d).collect()
    want = Counter()
    for i, t in docs:
        same = [comp[j] for j, u in docs if j is not None and (fps[(j, u)] ^ fps[(i, t)]).bit_count() <= 0]
        want[(i, f"{fps[(i, t)]:016x}", comp[i] if i is not None else min(same, default=None))] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_links_and_chains(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in fps[:40]:  # chains of neighbours 1 to 3 bits apart, some 4 apart
        g = f
        for _ in range(3):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(x - (1 << 64) if x >> 63 else x for x in fps))
    df = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    got = Counter((min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df).collect())
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3}
    assert set(got) == want and set(got.values()) <= {1} and len(want) > 50
    from orrery.operators.graph import connected_components

    comp = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    brute = brute_components(list(range(len(fps))), [x & (1 << 64) - 1 for x in fps])
    assert all(comp.get(i, i) == c for i, c in brute.items())


def shingle_sets(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_alike_finds_texts_of_likeness(spark):
    rng = np.random.default_rng(6)
    rows, vocabulary = [], [f"word{i}" for i in range(3000)]
    for i in range(150):  # a text and a copy with up to seven words replaced
        words = [vocabulary[k] for k in rng.integers(0, 3000, int(rng.integers(4, 300)))]
        copy = list(words)
        for k in rng.integers(0, len(words), i % 8):
            copy[k] = vocabulary[int(rng.integers(0, 3000))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (None, "one"), (None, "two"), (0, rows[0][1])]
    got = simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    parts = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    sets = {i: shingle_sets(t) for i, t in rows[:300]}
    near = [i for i in range(0, 300, 2) if likeness(sets[i], sets[i + 1]) >= 0.8]
    assert len(near) > 60 and sum(parts[i + 1] == i for i in near) >= 0.97 * len(near)
    assert all(parts[i + 1] == (i if i in near else i + 1) or i in near for i in range(0, 300, 2))
    assert [parts[i] for i in range(1000, 1005)] == [1000, 1000, 1000, 1003, 1003]
    assert Counter(r.component_id for r in got if r.doc_id is None) == {1003: 1, None: 1}
    assert simhash.alike(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 6: mixing --------------------------------------------------------------------------


def brute_targets(sizes: dict):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    total, clamped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in clamped)
        w = sum(weight[s] for s in order if s not in clamped)
        new = {s for s in order if s not in clamped and weight[s] * rest / w > 2 * sizes[s] + 1e-9} if w else set()
        if not new:
            return {s: 2.0 * sizes[s] if s in clamped else weight[s] * rest / w for s in order}
        clamped |= new


@pytest.mark.parametrize("where", ["odd", "none", SF])
def test_mixing_query(spark, where, request):
    d = where if where.startswith("/") else request.getfixturevalue(where)
    rows = table(spark, d, "documents").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    targets = brute_targets(sizes)
    got = mixing.mix(table(spark, d, "documents")).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 2 for s, t in targets.items())
    assert rows_of(mixing.op6(spark, d)) == rows_of(mixing.op6(spark, d))


# --- 7: packing -------------------------------------------------------------------------


@pytest.mark.parametrize("where", ["odd", "none", SF])
def test_packing_query(spark, where, request):
    from tokenizers import Tokenizer

    d = where if where.startswith("/") else request.getfixturevalue(where)
    tk = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((i, tuple([*tk.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs_of(spark, d))
    pieces = packing.pack(table(spark, d, "documents")).toPandas().sort_values(["sequence_id", "offset"])
    docs, streams = Counter(), []
    for p in pieces.itertuples():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        if p.start == 0:
            streams.append((p.doc_id, p.doc_tokens, []))
        assert streams[-1][0] == p.doc_id or (streams[-1][0] is None) or p.doc_id != p.doc_id
        assert len(streams[-1][2]) == p.start
        streams[-1][2].extend(ids)
    for i, n, ids in streams:
        assert n == len(ids)
        docs[(None if i is None or i != i else int(i), tuple(ids))] += 1
    assert docs == want
    if len(pieces):
        fill = pieces.groupby("sequence_id").length.sum()
        assert (fill.iloc[:-1] == 1024).all() and list(fill.index) == list(range(len(fill)))
        at = pieces.groupby("sequence_id").length.cumsum() - pieces.length
        assert (at == pieces.offset).all()
    crc = packing.digest(packing.pack(table(spark, d, "documents"))).collect()
    by = {(r.sequence_id, r.offset): r.ids_crc32 for r in crc}
    assert all(by[(p.sequence_id, p.offset)] == zlib.crc32(p.ids) for p in pieces.itertuples())


def test_fast_encoder_agrees():
    from tokenizers import Tokenizer

    tk, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for text in ["", " ", "<|endoftext|> a", "don't  \n\n x", "é𝔘​\u0000", " " * 5000 + "a", "ab" * 20000, "﻿|#!?" * 50]:
        assert fast(text).tolist() == tk.encode(text, add_special_tokens=False).ids


# --- 8: lines ---------------------------------------------------------------------------


@pytest.mark.parametrize("where", ["odd", "none", SF])
@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, where, batches, request):
    d = where if where.startswith("/") else request.getfixturevalue(where)
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs = [(i, (t or "").split("\n")) for i, t in docs_of(spark, d)]
    rank = lambda i: (1 << 63) if i is None else i
    owner = {}
    for i, parts in docs:
        for k in map(key, parts):
            if len(k) >= 10:
                owner[k] = min(owner.get(k, 1 << 64), rank(i))
    want = Counter()
    for i, parts in docs:
        kept = [x for x in parts if owner.get(key(x), 1 << 64) >= rank(i)]
        want[(i, len(parts), len(parts) - len(kept), "\n".join(kept))] += 1
    got = linededup.drop_repeated_lines(table(spark, d, "documents"), batches=batches).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want


def test_runs_are_compacted(spark):
    batch = lambda i: spark.createDataFrame([(h, 0, 10 * i + h) for h in range(i + 2)], "h1 long, h2 long, did long")
    runs = linededup.LineRuns(spark, fanout=2)
    with linededup.sorted_buckets(spark):
        for i in range(5):
            runs.add(batch(i))
        assert [len(x) for x in runs.levels] == [1, 0, 1]
        # a batch is dealt out and sorted once; the runs are read as they lie
        found = plan(runs.fresh(batch(5)))
        assert found.count("SortMergeJoin") == 2 and found.count("Exchange") == 1 and found.count("Sort ") == 1
        found = plan(runs.merged(runs.runs()))
        assert found.count("SortMergeJoin") == 1 and "Exchange" not in found and "Sort " not in found
    assert sorted((r.h1, r.owner) for r in runs.owners().collect()) == [(0, 0), (1, 1), (2, 12), (3, 23), (4, 34), (5, 45)]
    runs.close()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pii_spans_give_way_to_selected_ones_only(spark):
    spans = [(-0.9, 0, 0, 10, 0.9), (-0.8, 1, 8, 20, 0.8), (-0.7, 0, 18, 30, 0.7), (-0.6, 2, 25, 40, 0.6)]
    df = spark.createDataFrame([(spans,), ([],)], "r array<struct<rank:double,k:int,s:int,e:int,p:double>>")
    got = [[(x.k, x.s, x.e) for x in r.got] for r in df.select(pii.select_spans(F.col("r")).alias("got")).collect()]
    assert got == [[(0, 0, 10), (0, 18, 30)], []]


# --- 9: languages -----------------------------------------------------------------------


def test_language_id(spark, odd, none):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    got = langid.op9(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    by = Counter((r.doc_id, r.lang_pred == "und") for r in langid.op9(spark, odd).collect())
    assert {i for (i, und), _ in by.items() if und} == {2, 3, 4, 120}
    assert len(langid.op9(spark, odd).collect()) == len(TEXTS) and not langid.op9(spark, none).collect()


def test_all_languages_are_learnt(spark):
    rng = np.random.default_rng(4)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(70):  # each label has words of its own; the last six have fewest documents
        words = ["".join(letters[i] for i in rng.integers(0, 26, 7)) for _ in range(12)]
        for j in range(8 if k < 64 else 4):
            rows.append((10 * k + j, " ".join(rng.permutation(words)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [f"l{k:02}" for k in range(70)] and model.masks.shape[0] == 2
    got = langid.classify(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang and r.score > 0.5 for r in got)


def test_language_false_hits_are_taken_out():
    rng = np.random.default_rng(1)
    masks = (rng.random(1 << 12) < 0.5).astype(np.uint64)
    model = langid.LanguageModel(["x"], masks, np.array([float((masks & np.uint64(1)).mean()) ** 2]), 3, 2)
    grams = rng.integers(0, 1 << 62, 50_000).astype(np.uint64)
    share = model.scores(np.array([[int(model.hits(grams).sum())]]), np.array([len(grams)]))[0, 0]
    assert share < 0.02


def whole_grams(text, n=3):
    """All n-grams of a text at once, as strings."""
    out = " "
    for c in text.lower().replace("ς", "σ") + " ":
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return [out[i : i + n] for i in range(len(out) - n + 1)]


def test_language_id_against_sets(spark, monkeypatch):
    """Filters against exact sets of n-grams; a small window leaves everything as it is."""
    docs = table(spark, SF, "documents")
    model = langid.train(docs, max_docs=10**6)
    kept = {}
    for lang in model.languages:
        rows = docs.where(F.col("lang") == lang).where(~langid.held_out()).where("text is not null").collect()
        counts = Counter(g for r in rows for g in whole_grams(r.text))
        code = lambda g: int(langid.gram_hashes(np.array([ord(c) for c in g]), 3)[0].astype(np.int64))
        kept[lang], seen = set(), 0
        for g, c in sorted(counts.items(), key=lambda x: (-x[1], code(x[0]))):
            if seen < 0.98 * sum(counts.values()):
                kept[lang].add(g)
            seen += c
    for r in langid.classify(docs, model).collect():
        grams = whole_grams(r.text or "")
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {k: sum(g in kept[k] for g in grams) / len(grams) for k in model.languages}
        assert abs(share[r.lang_pred] - max(share.values())) < 0.02 and abs(r.score - max(share.values())) < 0.02
    text = "Ὀδυσσεύς  ab12cd İx straße ΣΑΣ—ς " * 50
    before = langid.popcounts(model, text)
    for window in (1, 7, 64):
        monkeypatch.setattr(langid, "WINDOW", window)
        after = langid.popcounts(model, text)
        assert after[1] == before[1] and (after[0] == before[0]).all()


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "pii", "with_next"])
def test_columns_of_any_name_keep_their_values(spark, name):
    run = {
        "language_id": lambda df: langid.classify(df, langid.train(df)),
        "line_dedup": linededup.drop_repeated_lines,
        "pii": pii.detect,
        "with_next": lambda df: sketches.with_next(df, ["text"]),
    }[name]
    own = {"language_id": {"lang_pred", "score"}, "line_dedup": {"kept_text", "n_lines", "n_dropped"}, "pii": {"base", "spans"}, "with_next": {"next_text"}}[name]
    df = frame(spark)
    plain = run(df)
    extra = [*{*plain.columns} - {*df.columns}, "judged", "did", "row", "parts", "gone", "found", "asked", "likely", "given_0", "at", "dealt", "bucket", "order_hash", "Base_", "_row", "_text", "a.b"]
    marked = df.withColumns({c: F.lit(f"mark {c}") for c in extra})
    got = run(marked)
    assert sorted(got.columns) == sorted(marked.columns)
    rows = got.collect()
    assert all(r[c] == f"mark {c}" for r in rows for c in set(extra) - own)
    names = sorted(plain.columns)
    assert Counter(str([r[n] for n in names]) for r in rows) == Counter(str([r[n] for n in names]) for r in plain.collect())


def test_extra_columns_change_nothing(spark):
    names = ["size", "part", "fp", "sig", "score", "line", "node", "source_size", "taken", "row_hash", "order", "stratum", "before", "n", "ids", "key", "host", "rank", "layout"]
    df, more = frame(spark), frame(spark).withColumns({c: F.lit("x") for c in names})
    for run in (simhash.near_duplicates, simhash.alike, mixing.mix):
        assert rows_of(run(df)) == rows_of(run(more))
    total = lambda rows: packing.pack(rows).agg(F.sum("length")).first()[0]
    assert total(df) == total(more)
