"""Toxicity, quality, WARC packages and the pipeline."""

import base64
import hashlib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import quality, toxicity, warc_zip

from .conftest import with_clashes

SF = "/root/testdata/sf0.01"


def labelled(n=400):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words, y = [rng.choice(plain) for _ in range(rng.randint(10, 80))], int(i % 4 == 0)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm", "hatefulness", "scoundrel"]))
        out.append((i, " ".join(words), y))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    model = toxicity.fit([t for i, t, _ in rows if i % 5], [y for i, _, y in rows if i % 5])
    df = with_clashes(spark.createDataFrame([(i, t) for i, t, _ in rows if i % 5 == 0] + [(900, None), (901, ""), (None, "x"), (902, "word " * 50_000)], "doc_id long, text string"))
    got = {r["id"]: r["score"] for r in toxicity.score(df, model).collect()}
    truth = {i: y for i, _, y in rows}
    right = [(got[i] >= 0.3) == bool(truth[i]) for i in got if i in truth]
    assert np.mean(right) >= 0.95 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.3


def test_toxicity_without_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit_from_labels(docs, labels)).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def test_toxicity_scores_keep_their_meaning_when_labels_are_sampled(spark, monkeypatch):
    # a weak sign: in half of the toxic texts and in a tenth of the others; one label in ten is toxic
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(3000):
        y = int(i % 10 == 0)
        words = [rng.choice(plain) for _ in range(30)] + ["vileword"] * (rng.random() < (0.5 if y else 0.1))
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = {}
    for at_most in (5000, 150):
        monkeypatch.setattr(toxicity, "SAMPLE", at_most)
        scores = toxicity.score(df, toxicity.fit_from_labels(df, df)).toPandas()["score"]
        seen[at_most] = scores.mean()
    assert seen[5000] == pytest.approx(0.1, abs=0.01) and seen[150] == pytest.approx(0.1, abs=0.04)
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    few = df.filter("toxic = 0 OR doc_id < 30")
    assert toxicity.fit_from_labels(few, few).constant == pytest.approx(3 / 2703)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    good, right = rng.random(20_000) < 0.8, (0.95, 0.9, 0.85, 0.8)
    patterns = {}
    for g in good:
        p = "".join("-" if rng.random() < 0.2 else "1" if (rng.random() < a) == g else "0" for a in right)
        patterns[p] = patterns.get(p, 0) + 1
    share, table = quality.estimate_accuracies(patterns)
    assert share == pytest.approx(0.8, abs=0.02)
    for k, a in enumerate(right):
        assert table[k, 1, 1] / (table[k, 1, 0] + table[k, 1, 1]) == pytest.approx(a, abs=0.02)


def test_quality(spark, docs, no_docs):
    got = quality.quality_scores(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(no_docs).count() == 0
    scored = quality.op9_quality(spark, SF)
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    cells = {(r["quality"], r["predicted"]): r["n"] for r in scored.join(truth, "doc_id").groupBy("quality", "predicted").agg(F.count("*").alias("n")).collect()}
    assert cells.get((1, 0), 0) <= 0.01 * cells[1, 1] and cells[0, 0] >= 0.9 * (cells[0, 0] + cells.get((0, 1), 0))


def test_packages_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y\r\n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "z" * 300_000), (None, "http://e", "<p>é</p>"), (2, "http://b", "<p>é</p>")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    packages = warc_zip.write_packages(df, str(tmp_path / "w"))
    got = sorted(warc_zip.read_packages(packages).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (None, "revisit", 1)]
    for r in got:
        html = dict((i, h or "") for i, _, h in rows)[r["page_id"]].encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html
    for r in packages.collect():
        with zipfile.ZipFile(r["uri"]) as z:
            assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_zip64_directories(tmp_path):
    import struct

    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        with z.open("b", "w", force_zip64=True) as f:
            f.write(b"second")
        z.writestr(zipfile.ZipInfo("c"), b"packed" * 9, zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    found = warc_zip.members(lambda s, n: data[s : s + n], len(data))
    assert {k: data[s : s + n] for k, (s, n) in found.items()} == {"a": b"first", "b": b"second"}
    # the same directory behind a ZIP64 end record, with the old one's fields overflown
    end = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    big = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    wide = data[:end] + big + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.members(lambda s, n: wide[s : s + n], len(wide)) == found


def test_foreign_packages_are_read(spark, tmp_path):
    """Index gzipped, with keys before the JSON, numbers as texts and names without the folder; records with a gap between them."""
    import gzip

    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    records = [gzip.compress(warc_zip.record_bytes(i, f"http://x/{i}", b"<p>%d</p>" % i, digest(b"<p>%d</p>" % i), None)) for i in range(3)]
    data, lines = b"".join(records), []
    for i in (2, 0):
        lines.append(f'com,x)/{i} 20240101 ' + '{"url": "http://x/%d", "filename": "d.warc.gz", "offset": "%d", "length": "%d"}' % (i, sum(map(len, records[:i])), len(records[i])))
    with zipfile.ZipFile(tmp_path / "f.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/d.warc.gz", data)
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta", *lines]).encode()))
    got = warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/f.wacz",)], "uri string")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(0, b"<p>0</p>"), (2, b"<p>2</p>")]
    with zipfile.ZipFile(tmp_path / "none.wacz", "w") as z:
        z.writestr("a", b"b")
    with pytest.raises(Exception, match="no index"):
        warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/none.wacz",)], "uri string")).count()


def test_op6_equals_brute_force(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    want = [(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages]
    assert sorted(map(str, map(tuple, warc_zip.op6_warc_zip(spark, SF).collect()))) == sorted(map(str, want))


def test_op7_equals_brute_force_and_finds_held_out_rows(spark):
    """Scores from plain compression of each text under the fitted dictionaries, outside Spark."""
    import zlib

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_from_labels(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    windows = toxicity.Windows(model.ordinary, model.toxic)
    want = {}
    for r in docs.collect():
        words = toxicity._WORD.findall((r["text"] or "").lower())
        saved = sorted((len(windows.ordinary(w)) - len(windows.toxic(w)) for w in (b"".join(map(toxicity.symbols, words[i : i + 16])) for i in range(0, len(words), 16))), reverse=True) or [0]
        x = np.array([1, np.mean(saved), np.mean(saved[:3]), saved[0]]) @ np.array(model.weights)
        want[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2, 1 / (1 + np.exp(-x)))
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (held, s) in want.items():
        assert got[i]["held_out"] == held and got[i]["score"] == pytest.approx(s, abs=1e-9) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if got[r["doc_id"]]["held_out"]}
    assert np.mean([got[i]["predicted"] == y for i, y in truth.items()]) >= 0.9


def test_labels_that_conflict_are_settled_alike(spark):
    texts, ys = [t for _, t, _ in labelled(80)], [y for _, _, y in labelled(80)]
    texts, ys = texts + texts[:10], ys + [1 - y for y in ys[:10]]
    assert toxicity.fit(texts, ys) == toxicity.fit(texts[::-1], ys[::-1])


def test_op9_posteriors_follow_from_its_votes(spark):
    """A plain expectation-maximisation, document by document."""
    rows = quality.op9_quality(spark, SF).collect()
    votes, share, n = [r["votes"] for r in rows], 0.5, len(quality.HEURISTICS)
    good = [(v.count("1") + 0.5) / (v.count("1") + 2 * v.count("0") + 1) for v in votes]
    for _ in range(200):
        share, old = (sum(good) + 1) / (len(votes) + 2), share
        table = [[{c: 1.0 for c in "01-"} for _ in (0, 1)] for _ in range(n)]
        for v, g in zip(votes, good):
            for k, c in enumerate(v):
                table[k][0][c] += 1 - g
                table[k][1][c] += g
        ratio = [{c: np.log(t[1][c] / sum(t[1].values()) / (t[0][c] / sum(t[0].values()))) for c in "01"} | {"-": 0.0} for t in table]
        good = [1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + sum(ratio[k][c] for k, c in enumerate(v)), -40, 40))) for v in votes]
        if abs(share - old) < 1e-9:
            break
    assert [r["posterior"] for r in rows] == pytest.approx(good, abs=1e-6)
    assert all(r["kept"] == (r["score"] >= quality.THRESHOLD) == bool(r["predicted"]) for r in rows)
    assert np.corrcoef([r["score"] for r in rows], good)[0, 1] > 0.9


def test_stages_on_no_rows_and_clashing_names(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    labels.write.mode("overwrite").parquet((at := warc_zip.scratch_path(spark, "sf")) + "/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, no_docs):
            out = stage(spark, given, at)
            assert name == "packing" or out.columns == given.columns
            assert (out.count() > 0) == (given is docs), name


def test_pipeline(spark):
    from quillon.llm._common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "t")
        if name != "packing":
            assert docs.columns == columns
        ids[name] = {r[0] for r in docs.select("doc_id").distinct().collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r["id"]: r["score"] for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.fit_from_labels(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id"))))).collect()}
    left = {i for i in texts if scores[i] < toxicity.THRESHOLD}
    assert ids["toxicity"] == left
    last = {}
    for i in sorted(left):
        last[texts[i]] = i
    assert ids["exact dedup"] == set(last.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := texts[i].encode().lower().split()) else set() for i in last.values()}
    owners, near = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in owners[x] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = find(i), find(j)
                near[max(a, b)] = min(a, b)
    assert ids["minhash near-dedup"] == {find(i) for i in sets}
    assert ids["packing"] == ids["source mixing"] <= ids["minhash near-dedup"]
    total = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert total.filter("n <> end OR n > 2048").count() == 0
