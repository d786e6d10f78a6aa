"""Merkle manifest, prefix trie and HyperMinHash against plain-Python versions, on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hyperminhash, merkle, trie

from .fixtures import TEXTS, frame, rows_of, written
from .test_documents import SF


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 12: Merkle manifest -----------------------------------------------------------------


def tree(leaves):
    """Root and the path of each leaf, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((i % 2 == 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return (nodes or [None])[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33, 57])
@pytest.mark.parametrize("layer", [1, 2, 3])
def test_fractal_traversal_gives_every_path(n, layer):
    leaves = [H(str(i)) for i in range(n)]
    root, want = tree(leaves)
    height = merkle.height_of(n)
    assert list(merkle.paths(leaves, height, layer)) == want
    assert merkle.block_root(leaves, height) == root
    lifted = list(merkle.paths(leaves, height + 2, layer))  # as the last block of a taller tree
    assert [p[:height] for p in lifted] == want and all(p[height:] == [(False, None)] * 2 for p in lifted)


def test_traversal_holds_few_nodes():
    leaves = [H(str(i)) for i in range(1024)]
    subtree = merkle.Subtree(leaves, 512, 4, 6).grow()
    assert sum(map(len, subtree.nodes)) == 4 + 2


def brute_manifest(rows):
    """By (doc_id, leaf): subroot, root and path."""
    groups = defaultdict(list)
    for i, lang, leaf in rows:
        groups[lang].append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    found = []
    for g, up in zip(names, above):
        for (there, i, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            found.append((i if there else None, leaf, trees[g][0], root, path + up))
    return sorted(found, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = [(i, "abc"[i % 7 % 3], H(str(i))) for i in range(60)] + [(7, None, H("x")), (7, None, H("x")), (None, None, H("y")), (None, "a", H("z")), (3, "z", H("3")), (9, "", H("9"))]
    leaves = spark.createDataFrame(rows, "doc_id long, grp string, leaf string").repartition(5).withColumn("claimed", F.lit(None).cast("string"))
    found = merkle.manifest(leaves)
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.sibling) for s in r.proof]) for r in found.collect()), key=repr)
    assert got == brute_manifest(rows)
    assert found.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.where(merkle.folded(F.lit(H("other")), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_of_nothing(spark, tmp_path):
    assert merkle.op12(spark, written(spark, tmp_path, [])).collect() == []


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_manifest_query(spark, tmp_path):
    got = {(r.doc_id, r.leaf): r for r in merkle.op12(spark, written(spark, tmp_path)).collect()}
    leaf = lambda i, t, lang, s, n: H("".join(map(field, (i, s, lang, n, t))))
    want = brute_manifest([(i, lang, leaf(i, t, lang, s, n)) for i, t, lang, s, n in TEXTS])
    assert {(w[0], w[1]) for w in want} == set(got)
    struck = {i for i, *_, n in TEXTS if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    for i, digest, subroot, root, path in want:
        r = got[i, digest]
        assert (r.subroot, r.root) == (subroot, root) and r.verified == (i not in struck) == (r.folded_root == root)
        if i != 9:  # two rows alike have one path each
            assert r.proof_sha256 == H("".join(s for _, s in path if s))


# --- 13: prefix trie ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
TALKS = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} said {min(c % 3, t)}") for c in range(45) for t in range(c % 5 + 1)]
    + [(-20, 0, "user", "turn 0 said 0"), (-7, 0, None, None), (-7, None, "user", "first of all"), (-7, None, "user", "first of all"), (50, 1, "user", ""), (50, 1, None, "tie")]
    + [(None, 0, "user", "nobody"), (101, 0, "a", "b"), (103, 3, "us", "er: x"), (104, 3, "use", "r: x")]
)


def brute_trie(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            talks[c].append(((t is not None, t or 0), role or "", said, text or ""))
    talks = {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full = tuple(talks.get(base, [])[:h] + own[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    found = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        children = sum(len(q) == len(path) + 1 for q in below)
        found.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children, len(childless), saved, H(",".join(map(str, sorted(ends[path]))))))
    return sorted(found, key=repr)


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, tmp_path, small, monkeypatch):
    if small:  # many parts, short runs and tables that are passed on early
        for name, n in (("FAN", 2), ("RUN", 2), ("HELD", 3)):
            monkeypatch.setattr(trie, name, n)
    spark.createDataFrame(TALKS, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie_rows(trie.op13(spark, str(tmp_path))) == brute_trie(TALKS)


def test_trie_of_a_long_conversation_and_of_none(spark, tmp_path):
    rows = [(c, t, "user", f"x {t}") for c in (1, 2) for t in range(300)]
    nodes = trie.prefix_trie(trie.digests(spark.createDataFrame(rows, TURNS)).select("conv_id", F.lit(1).alias("own"), "turn", "role", "digest", "words", F.lit(0).alias("skip")))
    top = nodes.where("depth = 0").first()
    assert nodes.count() == 301 and (top.n_leaves, top.saved_tokens, top.n_convs) == (1, 600, 2)
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op13(spark, str(tmp_path)).collect() == []


# --- 11: HyperMinHash --------------------------------------------------------------------


def word_sets(text, words=3):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute_near(rows, percent=85):
    sets = [(i, frozenset(word_sets(t))) for i, t in rows]
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i, i is not None and i == (least.get(root(k)) if s else i)) for k, (i, s) in enumerate(sets)), key=repr)


def near_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_near_duplicates_of_odd_rows(spark, tmp_path):
    assert near_rows(hyperminhash.op11(spark, written(spark, tmp_path / "a"))) == brute_near([(i, t) for i, t, *_ in TEXTS])
    assert hyperminhash.op11(spark, written(spark, tmp_path / "b", [])).collect() == []


def families(n, words, edits, seed=3):
    """Texts of a few families, copies of which have up to so many words changed."""
    rng = np.random.default_rng(seed)
    heads = [[f"w{rng.integers(5000)}" for _ in range(words)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = list(heads[i % 4])
        for at in rng.integers(words, size=rng.integers(edits + 1)):
            text[at] = f"e{rng.integers(10**9)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("crowded", [0, 16])
def test_near_duplicates_of_families(spark, crowded, monkeypatch):
    monkeypatch.setattr(hyperminhash, "CROWDED", crowded)
    rows = families(240, 90, 12) + [(1000 + i, t) for i, t in families(60, 7, 1, 4)]
    got = near_rows(hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = brute_near(rows)
    assert len({w[2] for w in want}) > 100  # the families are broken up
    assert got == want


@pytest.mark.parametrize("earlier", [0, 64])
def test_pairs_meet_once_at_rare_shingles(spark, earlier, monkeypatch):
    """All the classes' pairs in one crowded bucket that are likely to link; none again at its second common shingle."""
    monkeypatch.setattr(hyperminhash, "EARLIER", earlier)
    rows = families(80, 90, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = hyperminhash.stash(hyperminhash.sketches(docs).dropDuplicates(["set"]))
    held = nodes.select(F.lit(1).alias("key"), "set", F.col("set").alias("class"), F.lit(99).alias("size"))
    got = [(bytes(r.a), bytes(r.b)) for r in hyperminhash.meetings_by_rare_shingles(held, nodes, docs, "text", 3, 85).collect()]
    texts = dict(rows)
    sets = {bytes(r.set): word_sets(texts[r.doc_id]) for r in nodes.select("set", "doc_id").collect()}
    alike = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(alike) > 50 and alike <= set(map(frozenset, got))
    assert (len(got) == len(set(map(frozenset, got)))) == (earlier == 64)


def test_estimates(spark):
    """Estimates lie about the true likeness, and unlike sets come out near 0."""
    rng = np.random.default_rng(1)
    pool = rng.integers(1 << 63, size=4000).astype(np.uint64)
    off = []
    for shared in (0, 500, 900, 1000):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        x, y = hyperminhash.compressed(np.stack([hyperminhash.minima(a), hyperminhash.minima(b)]))
        luck = hyperminhash.chance(np.array([1000]))[0]
        off.append(((x == y).mean() - luck) / (1 - luck) - shared / (2000 - shared))
    assert max(map(abs, off)) < 0.13 and abs(off[0]) < 0.02 and off[3] == 0


@pytest.mark.parametrize("n", [1, 5, 300])
def test_registers_equal_by_chance(n):
    rng = np.random.default_rng(n)
    draws = [hyperminhash.compressed(np.stack([hyperminhash.minima(rng.integers(1 << 63, size=n).astype(np.uint64) * np.uint64(2)) for _ in range(2)])) for _ in range(400)]
    found = np.mean([(a == b).mean() for a, b in draws])
    assert abs(found - hyperminhash.chance(np.array([n]))[0]) < 3e-4


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_prefix_trie"])
def test_new_queries_against_sql(spark, name):
    from orrery.llm import queries

    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in found.description)
    order = sorted(range(len(names)), key=lambda k: found.description[k][0])
    assert names == sorted(got.columns)
    assert rows_of(got) == sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
