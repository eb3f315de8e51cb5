"""Near duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import embedding_dedup, minhash_dedup
from quillon.llm._graph import connected_components
from quillon.llm._shingles import shingle_set

from .conftest import TEXTS, with_clashes

SF = "/root/testdata/sf0.01"


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingles_are_those_of_the_definition():
    for text in [None, "", " \n", "one", "one two", "a b c a b c a b c", "Ünï Cödé A b\x0bc\x0cd", "x\x00y x y", "A B C", TEXTS[0][1]]:
        assert len(shingle_set(text, 3)) == len(shingles(text, 3))
    assert (shingle_set("A b C d", 3) == shingle_set("a B c D", 3)).all()


def make_texts():
    """Copies of a few texts with one to many words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            out.append((i, " ".join(copy)))
            i += 1
    return out


@pytest.mark.parametrize("words,percent,leaf,block,most", [(3, 85, 512, 1024, 2_000_000), (5, 80, 4, 5, 2_000_000), (3, 85, 512, 1024, 300)])
def test_near_duplicates(spark, monkeypatch, words, percent, leaf, block, most):
    monkeypatch.setattr(minhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", most)
    texts = [r for r in make_texts()] + [(900, None), (901, ""), (902, " "), (903, "just two"), (904, "Just TWO")]
    df = with_clashes(spark.createDataFrame(texts + [(None, "just two"), (903, "just two")], "doc_id long, text string"))
    sets = {i: shingles(t, words) for i, t in texts}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, linked)
    got = minhash_dedup.near_duplicates(df, words=words, percent=percent).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["id"] is not None:
            assert r["component_id"] == want[r["id"]] and r["n_shingles"] == len(sets[r["id"]]) and r["kept"] == (r["id"] == r["component_id"])
    kept = minhash_dedup.drop_near_duplicates(df.filter("doc_id <> 903"), words=words, percent=percent)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for i, c in want.items() if i != 903} - {903} | {904}


def test_no_documents(spark, no_docs):
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = [v + s * rng.standard_normal(16) for v in rng.standard_normal((8, 16)) for s in (0, 0, 0.02, 0.1, 0.15, 0.2, 0.25, 0.3)]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [1.0, 2.0]), (506, [float("inf")] * 16), (None, rows[0][1])]
    df = with_clashes(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if near[a, b]])
    got = {r["id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum() - 1, want[i])
    for i, _ in odd[:-1]:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_estimate_is_unbiased_within_its_bound(spark):
    rng = np.random.default_rng(8)
    o, q = rng.standard_normal((2, 400, 64))
    q = embedding_dedup._unit(o + 0.6 * q)
    rows = [(i, 1, v.astype("<f8").tobytes()) for i, v in enumerate(o)]
    stored = embedding_dedup.coded(spark.createDataFrame(rows, "id long, size long, vector binary")).orderBy("id").toPandas()
    o = embedding_dedup._unit(o)
    f, signs = stored["factor"].to_numpy(), np.unpackbits(embedding_dedup._packed(stored).view(np.uint8), axis=1, bitorder="little")
    turned = q @ embedding_dedup._rotation(64).T
    bits = turned.shape[1]
    error = ((2.0 * signs - 1) * turned).sum(1) / np.sqrt(bits) / f - (o * q).sum(1)
    bound = embedding_dedup.EPS * np.sqrt((1 - f * f) / (f * f)) / np.sqrt(bits - 1)
    assert bits == embedding_dedup.BITS and abs(error.mean()) < 0.01 and (np.abs(error) < bound).all()


def test_planted_links_are_all_found(spark):
    """Clusters around 40 centres with cosines on both sides of the threshold, and one dense group."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([c + s * rng.standard_normal((12, 64)) for c, s in zip(centres, np.linspace(0.1, 0.3, 40))] + [centres[:1] + 0.12 * rng.standard_normal((300, 64))])
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    pairs = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    want = components(range(len(x)), pairs)
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(pairs) > 10_000
    assert sum(r["n_links"] for r in got) >= 0.999 * 2 * len(pairs) and all(r["n_links"] <= near[r["id"]].sum() - 1 for r in got)
    assert np.mean([r["component_id"] == want[r["id"]] for r in got]) >= 0.999


def test_op10_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, ids = unit @ unit.T >= 0.95, [r["vec_id"] for r in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b])
    got = sorted(map(tuple, embedding_dedup.op10_embedding_dedup(spark, SF).collect()))
    assert got == sorted((i, near[k].sum() - 1, want[i], want[i] == i) for k, i in enumerate(ids))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("depth", minhash_dedup.DEPTHS)
def test_pairs_at_the_threshold_share_a_node(percent, depth):
    rng, pairs = np.random.default_rng(percent + depth), 200_000
    agree = rng.random((pairs, minhash_dedup.MINIMA)) < percent / 100
    met = np.zeros(pairs, bool)
    for order in minhash_dedup._orders(minhash_dedup.orders_needed(percent, depth))[:, :depth]:
        met |= agree[:, order].all(1)
    assert (~met).sum() <= 1.6 * minhash_dedup.MISS * pairs


def test_paths_sort_as_their_labels_do():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (50, minhash_dedup.MINIMA)).astype("<u2")
    paths = minhash_dedup._paths(labels, 5)
    for o, order in enumerate(minhash_dedup._orders(5)):
        want = sorted(range(50), key=lambda i: (tuple(labels[i, order]), i))
        assert want == sorted(range(50), key=lambda i: (*paths[i, o], i))
        assert ((paths[:, None, o, 0] == paths[None, :, o, 0]) == (labels[:, None, order[:4]] == labels[None, :, order[:4]]).all(2)).all()


def test_a_large_group_is_confirmed_in_linear_work(spark, monkeypatch):
    """Near copies of one text, above LEAF at every depth; texts meet a bounded number of times each."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 32)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 64)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(600):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        texts.append((i, " ".join(copy)))
    met = []
    real = minhash_dedup._with_texts
    monkeypatch.setattr(minhash_dedup, "_with_texts", lambda groups, texts: met.append(groups.count()) or real(groups, texts))
    got = {r["id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=3, percent=85).collect()}
    sets = {i: shingles(t, 3) for i, t in texts}
    linked = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(linked) > 50_000 and got == components(sets, linked)
    assert sum(met) <= 8 * len(texts), met


def test_ids_that_repeat_with_other_texts(spark):
    long = lambda *extra: " ".join([*(f"w{i}" for i in range(40)), *extra])
    df = spark.createDataFrame([(1, long("a")), (1, "other words entirely here and there"), (2, long("b")), (3, "other words entirely here and there"), (4, None), (4, "x")], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, words=3, percent=85).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], set()).add((r["n_shingles"], r["component_id"]))
    assert len(got) == 6 and all(len(v) == 1 for v in by_id.values())
    assert len({c for i in (1, 2, 3) for _, c in by_id[i]}) == 2 and by_id[4] == {(1, 4)}


def test_op3_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingles(r["text"], 3) for r in rows}
    owners = {}
    for i, x in sets.items():
        for y in x:
            owners.setdefault(y, []).append(i)
    linked = [(i, j) for i, x in sets.items() for j in {j for y in x for j in owners[y] if j < i} if 100 * len(x & sets[j]) >= 85 * len(x | sets[j])]
    want = components(sets, linked)
    got = minhash_dedup.op3_minhash_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), want[i], want[i] == i) for i, s in sets.items()) and linked


@pytest.mark.parametrize("n", [2_000, 80_000, 1_000_000])
def test_vectors_at_the_threshold_share_a_bucket(n):
    k, tables = embedding_dedup.tables_needed(n, 0.95)
    rng, pairs = np.random.default_rng(n), 200_000
    agree = rng.random((pairs, embedding_dedup.BITS)) < 1 - np.arccos(0.95) / np.pi
    met = np.zeros(pairs, bool)
    for bits in embedding_dedup._table_bits(embedding_dedup.BITS, k, tables):
        met |= agree[:, bits].all(1)
    assert (~met).sum() <= 1.6 * embedding_dedup.MISS * pairs
