"""Secret scans, exact dedup and mixing against brute force and on edge cases."""

import hashlib
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, mixing, secrets

from .conftest import TEXTS

SF = "/root/testdata/sf0.01"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, no_docs):
    hard = ["secret=token: abcdefgh", "TOKEN='x' token=abcdef.1", "api_key:aaaaaa apikey = \"bbbbbbb\"", "éé token=1234567 🙂 passwd:zzzzzzz", "xpassword=a password=bcdefghi", "ghp_" + "aZ" * 18]
    rows = [r for r in TEXTS if r[0] is not None] + [(100 + i, t, "x") for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(docs.filter("doc_id IS NULL").select("doc_id", "text", "source"))
    got = {}
    for r in secrets.find_secrets(df).collect():
        got[r["id"]] = [tuple(s) for s in r["spans"]]
    assert len(got) == len({r[0] for r in rows}) + 1
    for i, text, _ in rows:
        assert [s for s in got[i] if s[1] < 3] == brute_spans(text), text[:50]
    assert got[105] == [(0, 4, 40, "github")]
    assert secrets.find_secrets(no_docs).count() == 0


def test_op1_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    extra = {r.kind: re.compile(r.pattern, re.A) for r in secrets.EXTRA_RULES}
    write = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    want = {}
    for r in rows:
        base = brute_spans(r["text"])
        more = [(m.start(), 3 + k, m.end(), kind) for k, (kind, p) in enumerate(extra.items()) for m in p.finditer(r["text"] or "")]
        counts = [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
        want[r["doc_id"]] = (r["doc_id"], *counts, hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + more)))
    got = {r["doc_id"]: tuple(r) for r in secrets.op1_secret_scan(spark, SF).collect()}
    assert got == want and any(w[5] for w in want.values())


def test_a_persistent_index_serves_later_rules(spark, docs, tmp_path):
    index = secrets.TrigramIndex(spark, str(tmp_path / "trigrams"), buckets=4)
    some = docs.select("doc_id", "text")
    index.add(some.filter("doc_id < 9"))
    index.add(some)
    assert index.table().count() == index.table().distinct().count() > 100
    late = (secrets.Rule("fox", r"brown f[aeiou]x"), secrets.Rule("lorem", r"lorem ipsum"))
    for rules in (secrets.BASE_RULES + secrets.EXTRA_RULES, late):
        own, kept = (sorted((r["id"] or 0, str(r["spans"])) for r in secrets.find_secrets(some, rules=rules, index=i).collect()) for i in (None, index))
        assert own == kept and any("fox" in s or "hex" in s for _, s in kept)
    index.drop()


def test_texts_of_ten_megabytes(spark):
    """Runs that hold the beginning of a match again and again take linear time."""
    texts = [(1, "eyJ" * 3_500_000), (2, "eyJ" * 3_000_000 + ".ab.cd"), (3, "password " * 1_200_000), (4, "akia" * 2_500_000), (5, "token" + " " * 10_000_000)]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 5, 9_000_006, "jwt")], 3: [], 4: [], 5: []}


def test_trigram_queries():
    q = lambda p: sorted(map(sorted, secrets.trigram_query(p)))
    assert q("[0-9a-f]{24,}") == [[]] and q("AKIA[A-Z]+") == [["aki", "kia"]]
    assert q("(abcd|bcd)x*") == [["bcd"]] and q("ab?cd") == [["abc", "bcd"], ["acd"]]
    assert q("(a*)(foobar)+") == [["bar", "foo", "oba", "oob"]]


def test_exact_dedup(spark, docs, no_docs):
    got = {(r["id"], r["digest"].hex()): r for r in exact_dedup.exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got[1, sha(TEXTS[0][1])]["keep_id"] == 2 and got[1, sha(TEXTS[0][1])]["group_size"] == 2
    assert got[4, sha("")]["keep_id"] == 5 and got[7, sha("word")]["keep_rows"] == 2
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.drop_duplicates(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


def test_index_persists_over_batches(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "seen texts'"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(first, index=index).collect())) == [(2, "b"), (3, "a")]
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "seen texts'"), expected=10**9)
    assert again.buckets == index.buckets == 8
    second = spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")
    assert {r["id"]: r["keep_id"] for r in exact_dedup.exact_groups(second, index=again).collect()} == {9: 3, 8: 8}
    assert again.table().count() == 3 and exact_dedup.drop_duplicates(second, index=again).count() == 0
    index.drop()
    exact_dedup.exact_groups(docs).count(), exact_dedup.drop_duplicates(docs).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession
from quillon.llm import exact_dedup, secrets
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1] + "/shared").config("spark.sql.warehouse.dir", sys.argv[1] + "/own").getOrCreate()
docs = spark.createDataFrame([(1, "a"), (2, "token: abcdefgh"), (3, "a")], "doc_id long, text string")
exact_dedup.drop_duplicates(docs, index=exact_dedup.DigestIndex(spark, sys.argv[1] + "/digests"))
secrets.TrigramIndex(spark, sys.argv[1] + "/trigrams", buckets=4).add(docs)
"""


def test_indexes_of_an_earlier_session(spark, tmp_path):
    done = subprocess.run([sys.executable, "-c", OTHER_SESSION, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    more = spark.createDataFrame([(9, "a"), (8, "token: abcdefgh"), (7, "new")], "doc_id long, text string")
    seen = exact_dedup.DigestIndex(spark, str(tmp_path / "digests"))
    assert seen.buckets == 8 and seen.table().count() == 2
    assert [r["doc_id"] for r in exact_dedup.drop_duplicates(more, index=seen).collect()] == [7] and seen.table().count() == 3
    index = secrets.TrigramIndex(spark, str(tmp_path / "trigrams"))
    before = index.table().count()
    index.add(spark.createDataFrame([(2, "token: abcdefgh")], "doc_id long, text string"))
    assert index.buckets == 4 and index.table().count() == before > 0
    index.add(more)
    found = {r["id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(more, index=index).collect()}
    assert found == {9: [], 8: ["assign"], 7: []}


def test_the_bitmap_keeps_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BITMAPS", 2)
    rows = spark.range(60_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    chosen = rows.filter("id % 100 = 7").select("key")
    kept = secrets._may_be(rows, chosen)
    assert kept.columns == ["key", "id"] and kept.filter("id % 100 = 7").count() == 600 and 600 <= kept.count() < 3000
    assert secrets._may_be(rows, chosen.limit(0)).count() == 0


def test_buckets_follow_the_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 10)
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "sized"), expected=195)
    assert index.buckets == 20
    index.drop()


def test_op4_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    want = [(r["doc_id"], max(g), len(g), r["doc_id"] == max(g), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows for g in [groups[r["text"] or ""]]]
    assert sorted(map(tuple, exact_dedup.op4_exact_dedup(spark, SF).collect())) == sorted(want)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark, docs, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + size(t)
    expected = brute_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(r["epochs"]) == r["taken"] and len(r["positions"]) == len(r["epochs"])
        assert all(0 <= p <= 1 for p in r["positions"])
    for s, t in expected.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - t) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(no_docs).count() == 0 and mixing.sample_documents(no_docs).count() == 0
    taken = mixing.sample_documents(docs)
    assert taken.columns == docs.columns and taken.count() > 0


def test_op5_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    of, source = {}, {r["doc_id"]: r["source"] for r in rows}
    for i, s in source.items():
        of[s] = of.get(s, 0) + size[i]
    target, taken, places = brute_targets(of), dict.fromkeys(of, 0), []
    got = mixing.op5_source_mixing(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        assert (r["position"] is None) == (r["taken"] == 0)
        places.append(2 if r["position"] is None else r["position"])
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and places == sorted(places)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op5_source_mixing(spark, SF).collect()))


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:02d}": (i * 37) % 11 * 10 for i in range(12)} | {None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_positions_follow_the_schedule(spark):
    u = [i / 10 for i in range(11)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    schedule = (0.5, 1.0, 1.5)
    t = [r[0] for r in df.select(mixing._inverse_demand(F.col("u"), schedule)).collect()]
    share = lambda x: 0.5 * x + 0.5 * x * x  # noqa: E731  the integral of 0.5 + t
    assert [share(x) for x in t] == pytest.approx(u)
