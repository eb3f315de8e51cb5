"""Nearest-neighbour joins against brute force."""

import sys

import numpy as np
import pytest

from quillon.operators import knn
from quillon.operators.knn_join import knn_join

module = sys.modules["quillon.operators.knn_join"]


def table(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def brute(corpus, queries, k, metric):
    out = {}
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and (metric != "cosine" or any(v))
    for i, q in queries:
        if not good(q):
            continue
        q, found = np.array(q, float), []
        for j, x in corpus:
            if i == j or not good(x):
                continue
            x = np.array(x, float)
            d = -(q @ x) if metric == "ip" else 1 - q @ x / np.sqrt((q @ q) * (x @ x)) if metric == "cosine" else np.sqrt(((q - x) ** 2).sum())
            found.append((round(float(d), 9), j))
        out[i] = [j for _, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("metric,held", [("l2", None), ("l2", 90), ("cosine", 150), ("ip", 150)])
def test_join_equals_brute_force(spark, metric, held, monkeypatch):
    if held:  # many blocks and groups; the cloud of near copies is cut into several
        monkeypatch.setattr(module, "BYTES", held * 8 * 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 5
    rows = [(i, centres[i % 8] + rng.normal(size=6) * 0.3) for i in range(300)]
    rows += [(300 + i, centres[0] + rng.integers(0, 3, 6) / 8) for i in range(150)]  # a third of all, many of them equal
    rows += [(900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [np.inf] * 6), (903, [0.0] * 6), (904, [])]
    df = table(spark, rows).repartition(5)
    got = {}
    for r in knn_join(df, df, 4, "id", "v", metric).orderBy("query_key", "rank").collect():
        got.setdefault(r["query_key"], []).append((r["key"], r["distance"]))
    want = brute(rows, rows, 4, metric)
    assert got.keys() == want.keys()
    vectors = dict(rows)
    for i, found in got.items():
        if [j for j, _ in found] != want[i]:  # equal but for rounding: the distances must agree
            q = np.array(vectors[i], float)
            far = [float(module._measure(q, np.array([vectors[j]], float), metric)[0]) for j in want[i]]
            assert np.allclose([d for _, d in found], far, atol=1e-9)


def test_far_blocks_are_left_out(spark, monkeypatch):
    # two clusters far apart: no query of one meets a block of the other
    monkeypatch.setattr(module, "BYTES", 40 * 8 * 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3) + (1000 if i % 2 else 0)) for i in range(400)]
    df = table(spark, rows)
    got = knn_join(df, df.filter("id < 20"), 3, "id", "v").collect()
    assert len(got) == 60 and all((r["query_key"] - r["key"]) % 2 == 0 for r in got)
    pivots = np.array([[0.0, 0, 0], [1000.0, 1000, 1000]])
    cells = module._Cells(pivots, "l2", 0.0)
    mask = cells.reached(np.array([[0.5, 0, 0]]), np.array([2.0]), np.array([0]), np.array([5, 5]), np.zeros(2), np.array([4.0, 4.0]))
    assert mask.tolist() == [[True, False]]


def test_few_rows(spark):
    df = table(spark, [(1, [1.0, 0]), (2, [0.0, 1])])
    assert [(r["query_key"], r["key"], r["rank"]) for r in knn_join(df, df, 5, "id", "v").orderBy("query_key").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert knn_join(df.limit(0), df, 5, "id", "v").count() == 0 and knn_join(df, df.limit(0), 5, "id", "v").count() == 0
    same = knn_join(df, df, 1, "id", "v", skip_self=False).collect()
    assert {(r["query_key"], r["key"], r["distance"]) for r in same} == {(1, 1, 0.0), (2, 2, 0.0)}


def test_search_from_an_earlier_hit(spark):
    df = table(spark, [(i, [float(i), 0]) for i in range(10)])
    near = knn.knn_of(df, "v", df.filter("id = 4").select("v"), 3, "id")
    assert [r["id"] for r in near.collect()] == [4, 3, 5]
    assert knn.knn_of(df, "v", df.filter("id = 40").select("v"), 3, "id").count() == 0


def test_medoids_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUPS_HELD", 3)
    rng = np.random.default_rng(7)
    rows = [(i, f"g{i % 40}", rng.normal(size=5).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(4)
    got = {r["group"]: r["key"] for r in knn.medoids(df, "g", "id", "v").collect()}
    for g in {r[1] for r in rows}:
        mine = [(i, np.array(v) / np.linalg.norm(v)) for i, h, v in rows if h == g]
        totals = {i: sum(1 - u @ w for _, w in mine) for i, u in mine}
        assert totals[got[g]] == pytest.approx(min(totals.values()), abs=1e-6)
