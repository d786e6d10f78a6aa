"""Images, chats and URLs, on odd rows and against brute force."""

import hashlib
import itertools
import json

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import chat, images, urlfilter

from .fixtures import rows_of

SF = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    c = duckdb.connect()
    for name, path in tables.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


# --- 2: images --------------------------------------------------------------------------


def picture(seed, side=64):
    rng = np.random.default_rng(seed)
    grid = images._shrink(rng.random((1, 8, 8)), 8 / side)[0]
    return np.uint8(np.clip(grid, 0, 1) * 255)


def as_row(i, a):
    return (i, *a.shape, a.tobytes()) if a is not None else (i, None, None, None)


def test_image_copies(spark):
    pics = {i: picture(i) for i in range(30)}
    rows = {i: a for i, a in pics.items()}
    rows[100] = pics[3].copy()  # the same pixels
    rows[101] = pics[4][5:, 3:]  # cropped
    rows[102] = np.uint8(pics[5] * 0.8 + 30)  # brightened
    rows[103] = np.ascontiguousarray(np.rot90(pics[6]))  # turned
    noisy = pics[7].astype(int) + np.random.default_rng(0).integers(-3, 4, pics[7].shape)
    rows[104] = np.uint8(np.clip(noisy, 0, 255))
    rows[105] = rows[101][:, :50]  # a crop of the crop
    rows[106] = np.full((64, 64), 9, np.uint8)  # no corners
    rows[107] = None
    df = spark.createDataFrame([as_row(*r) for r in rows.items()], "image_id long, height int, width int, pixels binary")
    odd = df.unionByName(df.where("image_id = 8")).unionByName(df.where("image_id = 9").withColumn("image_id", F.lit(None).cast("long")))
    got = images.copies(odd.withColumn("x", F.lit("extra")).withColumn("n_links", F.lit(1))).collect()
    found = {r.image_id: r.component_id for r in got}
    assert len(got) == len(rows) + 2
    want = {100: 3, 101: 4, 102: 5, 103: 6, 104: 7, 105: 4, None: 9}
    assert found == {i: want.get(i, i) for i in [*rows, None]}
    assert images.copies(df.limit(0)).count() == 0


def test_hot_buckets_keep_groups_together(spark):
    base = picture(1)
    rows = []
    for i in range(24):  # near copies that differ in one far pixel each
        a = base.copy()
        a[i, 0] = 255 - a[i, 0]
        rows.append(as_row(i, a))
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")
    got = images.copies(df).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(r.n_links for r in got) < 24 * 23


def test_bucket_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(20):
        n = int(rng.integers(1, 300))
        key = rng.integers(0, 1 << 63, 12).astype(np.int64)[rng.integers(0, 12, n)]
        for _ in range(int(rng.integers(0, 6))):
            key = np.where(rng.random(n) < 0.5, key ^ (np.int64(1) << rng.integers(0, 60, n)), key)
        columns = (rng.integers(0, 2, n), key, rng.integers(0, 40, n), np.arange(n))
        order = np.lexsort(columns[::-1])
        rows = [x[order].astype(np.int64) for x in columns]
        cuts = [0, *np.sort(rng.integers(0, n + 1, int(rng.integers(0, 8)))), n]
        blocks = ([x[i:j] for x in rows] for i, j in zip(cuts, cuts[1:]))
        got = set()
        for found in images.bucket_pairs(blocks, 11):
            got |= set(zip(*(x.tolist() for x in found)))
        table, key, image, corner = (x.tolist() for x in rows)
        differ = lambda i, j: (key[i] ^ key[j]) & (1 << 64) - 1  # noqa: B023, E731
        shared = [[64 - differ(i, j).bit_length() if table[i] == table[j] else 0 for j in range(n)] for i in range(n)]
        need = [next((k for k in range(images.LEAST_KEY, 65) if sum(x >= k for x in row) <= images.BUCKET), 65) for row in shared]
        met = [(i, j) for i in range(n) for j in range(i) if need[i] <= 64 and shared[i][j] >= need[i]]
        met += [(i, shared[i].index(64)) for i in range(n) if need[i] == 65]
        want = {(*min(a, b), *max(a, b)) for a, b in (((image[i], corner[i]), (image[j], corner[j])) for i, j in met if differ(i, j).bit_count() <= 11) if a[0] != b[0]}
        assert got == want


@pytest.mark.parametrize("chunk", [1024, 7])
def test_whole_buckets_are_those_of_brute_force(spark, chunk, monkeypatch):
    """Descriptors that crowd into few buckets: each near pair of different classes that shares one comes once."""
    monkeypatch.setattr(images, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (6, images.BITS), dtype=np.uint8)[rng.integers(0, 6, 300)]
    bits ^= rng.random(bits.shape) < rng.choice([0, 0.02, 0.06], 300)[:, None]
    rows = [(i // 3, i % 3, [int(x) for x in q]) for i, q in enumerate(images._longs(bits))]
    points = spark.createDataFrame(rows, "image_id long, corner int, quarters array<long>")
    parts = spark.createDataFrame([(i, i - i % 4) for i in range(60)], "node long, component long")
    met = [images.meetings_across(points, parts, range(t, t + 4), 24) for t in (0, 4)]
    got = sorted(tuple(r) for r in met[0].unionByName(met[1]).collect())
    kind = np.array([r[0] - r[0] % 4 if r[0] < 60 else r[0] for r in rows])
    shared = np.zeros((300, 300), dtype=bool)
    for order in images._orders():
        keys = bits[:, order[: images.LEAST_KEY]]
        shared |= (keys[:, None] == keys[None]).all(axis=2)
    near = shared & ((bits[:, None] != bits[None]).sum(axis=2) <= 24) & (kind[:, None] != kind[None])
    want = sorted((*rows[i][:2], *rows[j][:2]) for i, j in zip(*np.nonzero(near)) if i < j)
    assert len(want) > 1000 and got == want


def test_copies_among_crowded_corners_are_linked(spark, monkeypatch):
    """Two images of twelve corners that are 20 bits apart each; 400 other images have every one of these corners, or nearly."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, (12, images.BITS), dtype=np.uint8)
    flipped = lambda bits, n: bits ^ np.isin(np.arange(images.BITS), rng.permutation(images.BITS)[:n])
    corners = [(i, c, *rng.uniform(0, 64, 2), flipped(base[k], 6)) for i in range(1200) for c, k in enumerate(rng.permutation(12)[:4])]
    for k in range(12):
        flips, place = rng.permutation(images.BITS)[:20], (16.0 * (k % 4), 20.0 * (k // 4))
        corners += [(2000 + n, k, *place, base[k] ^ np.isin(np.arange(images.BITS), flips[n::2])) for n in range(2)]
    quarters = images._longs(np.array([c[-1] for c in corners]))
    rows = [(*(x if isinstance(x, int) else float(x) for x in c[:4]), 0, 0.0, [int(x) for x in q]) for c, q in zip(corners, quarters)]
    points = spark.createDataFrame(rows, "image_id long, corner int, x double, y double, scale int, turn double, quarters array<long>")
    monkeypatch.setattr(images, "descriptors", lambda chosen: points)
    df = spark.range(1200).union(spark.range(2000, 2002)).selectExpr("id as image_id", "8 as height", "1 as width", "cast(lpad(id, 8, '0') as binary) as pixels")
    assert {r.image_id: r.component_id for r in images.copies(df).collect()} == {i: i for i in range(1200)} | {2000: 2000, 2001: 2000}


def corner_table(spark, corners):
    """Corners (image, number, x, y, bits) as points."""
    quarters = images._longs(np.array([c[-1] for c in corners]))
    rows = [(int(i), int(k), float(x), float(y), 0, 0.0, [int(q) for q in word]) for (i, k, x, y, _), word in zip(corners, quarters)]
    return spark.createDataFrame(rows, "image_id long, corner int, x double, y double, scale int, turn double, quarters array<long>")


NO_PARTS = "node long, component long"


def test_corners_that_all_images_have_are_not_paired(spark):
    """300 images with the same three patterns: rows stay in proportion, and the one pair that has two more in common is found whole."""
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2, (3, images.BITS), dtype=np.uint8), rng.integers(0, 2, (300, 5, images.BITS), dtype=np.uint8)
    own[200, :2] = own[100, :2]
    corners = [(i, k, 9.0 * k, 0.0, common[k]) for i in range(300) for k in range(3)] + [(i, 3 + k, 9.0 * k, 9.0, own[i, k]) for i in range(300) for k in range(5)]
    spent = []
    found = images.matches_across(corner_table(spark, corners), spark.createDataFrame([], NO_PARTS), 24, 5, spent).collect()
    assert sorted((r.l_image_id, r.l_corner, r.r_image_id, r.r_corner) for r in found) == [(100, k, 200, k) for k in range(5)]
    assert sum(table.count() for table in spent) < 20 * 300


def test_places_set_aside_lose_no_match(spark, monkeypatch):
    """Against all near pairs: those of every image pair that may have five places in common, though each image's three most crowded are set aside."""
    monkeypatch.setattr(images, "LIGHT", 2)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (24, images.BITS), dtype=np.uint8)
    spots = rng.uniform(0, 64, (24, 2))
    corners = []
    for i in range(60):
        kinds = rng.choice(24, 8, replace=False, p=np.arange(24, 0, -1) / 300)
        kinds = np.r_[kinds, kinds[:2]]  # the same place at another scale
        for k, kind in enumerate(kinds):
            bits = base[kind] ^ (rng.random(images.BITS) < rng.choice([0, 0.03]))
            corners.append((i, k, *(spots[kind] + rng.uniform(-0.9, 0.9, 2)), bits))
    parts = spark.createDataFrame([(i, i - i % 3) for i in range(30)], NO_PARTS)
    points = corner_table(spark, corners)
    met = images.meetings_across(points, parts, range(images.TABLES), 24).collect()
    at = {c[:2]: complex(c[2], c[3]) for c in corners}
    by_pair = {}
    for r in met:
        by_pair.setdefault((r.l_image_id, r.r_image_id), []).append(((r.l_image_id, r.l_corner), (r.r_image_id, r.r_corner)))

    def apart(kept):
        return all(min(abs(at[a] - at[c]), abs(at[b] - at[d])) > images.APART for (a, b), (c, d) in itertools.combinations(kept, 2))

    may = {pair for pair, near in by_pair.items() if any(apart(kept) for kept in itertools.combinations(near, 5))}
    spent = []
    got = {(r.l_image_id, r.l_corner, r.r_image_id, r.r_corner) for r in images.matches_across(points, parts, 24, 5, spent).collect()}
    every = {(*a, *b) for near in by_pair.values() for a, b in near}
    assert spent[0].where("place = 2").count() and 10 < len(may) < len(by_pair)
    assert got <= every and {m for m in every if (m[0], m[2]) in may} <= got
    assert len({m[::2] for m in got}) < len(by_pair)
    assert sum(table.count() for table in spent[1:5]) < len(every)


def turned(a, degrees):
    h, w = a.shape
    t, (y, x) = np.deg2rad(degrees), np.mgrid[0:h, 0:w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    at = [np.clip(v, 0, n - 1.001) for v, n in ((np.cos(t) * dy - np.sin(t) * dx + (h - 1) / 2, h), (np.cos(t) * dx + np.sin(t) * dy + (w - 1) / 2, w))]
    return images._between(a[None].astype(float), np.zeros((h, w), int), *at)


RNG = np.random.default_rng(2)
EDITS = {
    "crop and brightness": lambda a: a[4:, 4:-4] * 0.85 + 20,
    "noise": lambda a: a + RNG.normal(0, 6, a.shape),
    "noise and crop": lambda a: (a + RNG.normal(0, 3, a.shape))[3:, 5:],
    "blur": lambda a: images._box(a[None].astype(float), 1)[0],
    "turn by 10 degrees": lambda a: turned(a, 10),
    "gamma": lambda a: 255 * (a / 255.0) ** 1.5,
    "resize by 1.5": lambda a: images._shrink(a[None].astype(float), 1.5)[0],
    "resize by 1.25": lambda a: images._shrink(a[None].astype(float), 1.25)[0],
}


def test_edited_copies_are_linked(spark):
    """Of 40 pictures, how many are linked with each edit of theirs; none with another's."""
    rows = {i: picture(i) for i in range(40)}
    for k, edit in enumerate(EDITS.values()):
        for i in range(40):
            rows[100 * (k + 1) + i] = np.uint8(np.clip(np.rint(edit(picture(i))), 0, 255))
    df = spark.createDataFrame([as_row(*r) for r in rows.items()], "image_id long, height int, width int, pixels binary")
    found = {r.image_id: r.component_id for r in images.copies(df).collect()}
    assert all(c % 100 == i % 100 for i, c in found.items())
    caught = {name: sum(found[100 * (k + 1) + i] == i for i in range(40)) for k, name in enumerate(EDITS)}
    print(caught)
    # 42 by 42 pixels leave few corners that are not too near the border
    assert all(n >= (8 if name == "resize by 1.5" else 36) for name, n in caught.items()), caught


def test_links_are_nearly_those_of_all_pairs(spark):
    """Image pairs that all pairs of corners within the largest distance would link, against those the tables link."""
    edits = [EDITS[k] for k in ("noise", "turn by 10 degrees", "resize by 1.25", "resize by 1.5")]
    rows = {i: picture(i) for i in range(12)}
    for k, edit in enumerate(edits):
        rows |= {100 * (k + 1) + i: np.uint8(np.clip(np.rint(edit(picture(i))), 0, 255)) for i in range(12)}
    df = spark.createDataFrame([as_row(*r) for r in rows.items()], "image_id long, height int, width int, pixels binary")
    points = images.stash(images.descriptors(df))
    corners = sorted(points.collect(), key=lambda r: (r.image_id, r.corner))
    bits = images._bits(np.array([r.quarters for r in corners]))
    met = []
    for i, p in enumerate(corners):
        for j in np.flatnonzero((bits != bits[i]).sum(axis=1) <= 24):
            q = corners[j]
            if p.image_id < q.image_id:
                met.append((p.image_id, p.corner, p.x, p.y, p.scale, p.turn, q.image_id, q.corner, q.x, q.y, q.scale, q.turn))
    place = lambda end: f"{end}_image_id long, {end}_corner int, {end}_x double, {end}_y double, {end}_scale int, {end}_turn double"
    every = {(r.a, r.b) for r in images.consensus(spark.createDataFrame(met, f"{place('l')}, {place('r')}")).collect()}
    found = {(r.a, r.b) for r in images.consensus(images.matches(points, 24, 5)).collect()}
    parts = {r.image_id: r.component_id for r in images.copies(df).collect()}
    assert len(every) > 60 and all(a % 100 == b % 100 for a, b in found) and sum(parts[a] == parts[b] for a, b in every) >= 0.9 * len(every)
    got = {(r.l_image_id, r.l_corner, r.r_image_id, r.r_corner) for r in images.matches(points, 24, 5).collect()}
    assert got <= {(m[0], m[1], m[6], m[7]) for m in met}


# --- 3: chats ---------------------------------------------------------------------------

control = st.lists(st.sampled_from(["<", ">", "[", "]", "/", "\\", "s", "INST", "SYS", "|", "turn", "end", "text", " ", "</s>", "[INST]", "<|end|>", "<<SYS>>", "\n", "é"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), control), control), max_size=4))
def test_chat_round_trip(turns):
    formatted, mask = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert "".join(chat.unescape(formatted[s:e]) for s, e in mask) == "".join(t for r, t in turns if r == "assistant")
    assert all(not m[2].startswith("\\") is (m[0] in (chat.TURN, chat.TEXT, chat.END)) or m[2] for m in chat.CONTROL.finditer(formatted))


def test_layouts(spark):
    ok = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", ok),
        ({"id": 4, "system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("system", "s"), *ok]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", ok),
        ({"instruction": "q", "output": "a"}, "instruction", ok),
        ({"instruction": "q", "input": None, "output": "a"}, "instruction", ok),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [("user", "q"), ("user", "i"), ("assistant", "a")]),
        ({"prompt": "q", "response": "a"}, "prompt_response", ok),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", ok),
        ({"question": "q", "answer": 3}, "question_answer", [("user", "q"), ("assistant", "3")]),
        ({"turns": []}, "turn_rows", []),
        ({"what": {"ever": [1]}}, None, None),
    ]
    raw = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, None), (91, "{broken"), (92, "[1]"), (93, "")]
    df = spark.createDataFrame(raw, "conv_id long, record string").withColumn("layout", F.lit("clash"))
    found = chat.format_records(df)
    by = {r.conv_id: r for r in found.collect()}
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(found).collect()}
    for i, (_, layout, want) in enumerate(records):
        assert by[i].layout == layout and by[i].fingerprint and turns.get(i) == want
    assert all(by[i].fingerprint is None and by[i].formatted is None for i in (90, 91, 92, 93))
    prints = [f for m in chat.MAPPINGS for f in m.fingerprints()]
    assert len(prints) == len(set(prints))


def test_chat_query(spark, tmp_path):
    assert rows_of(chat.op3(spark, SF)) == oracle(chat.OP3_SQL, conversations=f"{SF}/conversations.parquet")
    odd = [(1, 1, "assistant", None), (1, 0, "user", "a [INST] \\"), (1, 0, "user", "a [INST] \\"), (2, None, None, "<s>\n"), (None, 3, "assistant", ""), (3, 0, "tool\n", "x" * 50_000)]
    odd += [(5, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(3000)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(chat.op3(spark, str(tmp_path))) == oracle(chat.OP3_SQL, conversations=f"{tmp_path}/conversations.parquet/*.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    got = chat.op3(spark, f"{tmp_path}/none").collect()
    assert [(r.conv_id, r.n_turns, r.loss_sha256) for r in got] == [(-7, 2, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())]


# --- 10: URLs ---------------------------------------------------------------------------


def test_url_query(spark, tmp_path):
    assert rows_of(urlfilter.op10(spark, SF)) == oracle(urlfilter.OP10_SQL, pages=f"{SF}/pages.parquet")
    urls = [
        None, "", "no scheme example.org/es/", "http://", "http://EXAMPLE.org/es/x?y#z", "http://a.example.org/en/12", "http://example.org/en/2", "https://notexample.org/es/",
        "http://example.org", "http://example.org?/es/", "x://com/de/", "x://y.com/DE/", "http://x/org/", "http://spam-farm.net/a", "http://a.spam-farm.example.org/es/1", "http://ads.b.c/",
        "http://h.net/banner12/ads/x", "http://h.net/banner/x/ads", "http://h/wp-login.php", "http://h/wp-login.php5", "a://b://c.org/", "http://é.org/\n/x", "http://x.casino.net/", "http://my-casino.net", "//u.org/" + "p" * 20_000,
    ]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(5, urls[5], "h"), (None, urls[4], None), (4, urls[4], "other")]
    spark.createDataFrame(rows, "page_id long, url string, rank string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(urlfilter.op10(spark, str(tmp_path)))
    assert got == oracle(urlfilter.OP10_SQL, pages=f"{tmp_path}/pages.parquet/*.parquet") and len(got) == len(rows)
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert urlfilter.op10(spark, f"{tmp_path}/none").count() == 0


def test_rules_are_filed_under_whole_tokens():
    assert urlfilter.Rule("host", "block", "example.org/en/1").tokens() == ["example", "org", "en"]
    assert urlfilter.Rule("pattern", "block", "||Ads.*^").tokens() == ["ads"]
    assert urlfilter.Rule("pattern", "block", "ad*/banner/x").tokens() == ["banner"]
    assert urlfilter.Rule("pattern", "block", "foo").tokens() == []
    assert urlfilter.Rule("pattern", "block", "/a/foo|").tokens() == ["a", "foo"]


def test_rules_without_tokens_and_shuffled_rules(spark, monkeypatch):
    rules = [urlfilter.Rule("pattern", "block", "track"), urlfilter.Rule("pattern", "allow", "*")]
    df = spark.createDataFrame([(1, "http://a/xtracky"), (2, "http://a/b"), (3, None)], "page_id long, url string")
    for most in (1 << 20, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", most)
        got = {r.page_id: (r.pattern, r.verdict) for r in urlfilter.judge(df, rules).collect()}
        assert got == {1: ("track", "block"), 2: ("*", "allow"), 3: ("*", "allow")}
