"""Vector codes against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillon.llm import vector_codes

from .conftest import with_clashes


def brute(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owner = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, owner) if o == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for book in books for y in book for x in y)
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("spread", [0.01, 3.0, 9000.0])
def test_codes_equal_brute_force(spark, spread, monkeypatch):
    rng = random.Random(int(spread))
    rows = [(i, [rng.gauss(i % 3, spread) for _ in range(8)]) for i in range(420)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, None), (601, [1.0] * 7 + [None]), (602, [math.inf] * 8), (603, [math.nan] + [0.0] * 7), (604, [0.0] * 8), (605, [])]
    df = with_clashes(spark.createDataFrame([(i, v, None if i % 5 == 0 else i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3))
    got, books = vector_codes.compress(df, keep=("label",))
    want, digest = brute(rows)
    assert {r["id"]: (bytes(r["code"]).hex(), r["error"]) for r in got.collect()} == want
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() == digest


def test_the_query_on_a_table(spark, tmp_path):
    rows = [(i, [float(i % 7), 0.5, -1.25, i / 3], None if i % 2 else i % 3) for i in range(40)]
    df = with_clashes(spark.createDataFrame([*rows, (None, [0.0] * 4, 1), (99, [0.0] * 8, 1)], "vec_id long, embedding array<float>, label int"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).toPandas()
    assert len(got) == 41 and got["vec_id"].isna().sum() == 1 and got["codebooks_sha256"].nunique() == 1
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op13_vector_codes(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, [None, 1.0], 2), (2, None, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/bad/embeddings.parquet")
    assert vector_codes.op13_vector_codes(spark, f"{tmp_path}/bad").count() == 0


def test_search_from_any_entry_with_ties():
    rng = np.random.default_rng(4)
    book = rng.integers(-5, 5, (40, 3))
    book[7] = book[3]
    x = rng.integers(-9, 9, (300, 3))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    for start in (np.zeros(300, np.int64), rng.integers(0, 40, 300)):
        entry, least = vector_codes.Neighbours(book).search(x, start)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
