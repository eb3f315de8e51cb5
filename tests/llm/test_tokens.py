"""Packing and token counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing, token_counts

from .conftest import TEXTS

PATH = packing.tokenizer_path()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_on_hard_texts(library):
    rng = random.Random(11)
    texts = ["", " ", "\n\n a", "I've you're 'sabc ''s 'l 'll're", "x \n", "  x", "a<|endoftext|>b", "日本語 🙂👩‍👩‍👧", "a" * 700, "xyzzyabba" * 3000, "é漢🙂" * 200, " " * 700, "=-" * 400, "\x00\x85\x1c'", "aaa aaaa aaaaa"]
    for _ in range(400):
        alphabet = rng.choice(["abcdefg 'stremvld", "aAbB \n\t'", "é漢🙂 a1", "0123 456.,-_/", " \xa0\n a'"])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))))
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Transducer(PATH).count(texts).tolist() == expected


def test_long_pieces_compose_from_chunks(library):
    rng = random.Random(17)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = ["a" * n for n in (256, 257, 511, 512, 513, 5000, 100_003)] + [" " * 3000, "=" * 2777, "ab" * 4000, "-_" * 999 + "=" * 999, "\u6f22" * 900]
    texts += [word(a, n) for a in ("ab", "abcdefghijklmnop", "aeiou", "0123456789", "=-#", "漢字é") for n in (300, 700, 2000, 6000)]
    texts += ["x " + word("abc", 900) + " y " + word("etaoin", 1300)]
    machine = token_counts.Transducer(PATH)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(texts).tolist() == expected
    assert machine.count(texts[::-1]).tolist() == expected[::-1]


def test_maps_of_periodic_and_repeated_chunks(library, monkeypatch):
    """Chunks of equal bytes share a map with many entry states; pieces begin and end at any phase."""
    texts = ["=" * n for n in (256, 384, 512, 4096, 20_001)] + ["=-_" * 2000, "==-" * 3001, "-" * 300 + "=" * 3000 + "-" * 2000, "ab" * 700 + "a" * 2000, "\u6f22" * 2000 + "\u5b57" * 300]
    texts += ["=" * 5000 + " " + "a" * 700 + " " + "=" * 5001]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Transducer(PATH).count(texts).tolist() == expected
    monkeypatch.setattr(token_counts, "STEPS", 1)  # candidates found step by step
    assert token_counts.Transducer(PATH).count(texts[:3] + texts[5:7]).tolist() == expected[:3] + expected[5:7]


def test_op8_and_op2_equal_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows}
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 512) for r in rows)
    assert sorted(map(tuple, token_counts.op8_token_counts(spark, SF).collect())) == want
    got = packing.op2_packing(spark, SF).collect()
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        whole, at = np.array([*ids[i], 1], "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(whole)) and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(len(x) + 1 for x in ids.values()) >= 0.99 * 2048 * len(windows)


def test_chunked_scan_equals_one_pass():
    rng = np.random.default_rng(5)
    step, note = token_counts._splitter()
    classes = rng.integers(0, 12, 5000).astype(np.uint8)
    state, expected = token_counts.START, np.zeros(5000, bool)
    for i, c in enumerate(classes):
        n = note[state, c]
        expected[i] |= bool(n & token_counts.HERE)
        if n & token_counts.BACK:
            expected[i - 1] = True
        state = step[state, c]
    assert (token_counts.piece_starts(classes) == expected).all()


def test_token_counts(spark, docs, no_docs, library):
    got = token_counts.token_counts(docs, PATH).collect()
    assert len(got) == len(TEXTS)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in TEXTS)
    assert sorted((r["id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Transducer(packing.tokenizer_path("word_bpe_49k.json"))


def brute_best(counts, capacity):
    reach = {0}
    for n, c in counts.items():
        reach = {a + n * k for a in reach for k in range(c + 1) if a + n * k <= capacity}
    return max(reach)


def test_slack_plan_fills_best_and_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(8, capacity)))}
        plan = packing.slack_plan(counts, capacity)
        windows, seen = {}, {n: [] for n in counts}
        for n, first, end, per, window, at in plan:
            for rank in range(first, end):
                seen[n].append(rank)
                windows.setdefault(window + (rank - first) // per, []).append((at + (rank - first) % per * n, n))
        assert all(seen[n] == list(range(counts[n])) for n in counts)
        for pieces in windows.values():
            place = 0
            for offset, n in sorted(pieces):
                assert offset == place
                place += n
            assert place <= capacity
        head = max(counts)
        rest = {n: c - (n == head) for n, c in counts.items()}
        assert sum(n for _, n in windows[0]) == head + brute_best(rest, capacity - head)


def test_packing(spark, docs, no_docs, library):
    pieces = packing.tokenised_pieces(docs, PATH, capacity=64)
    from quillon.llm._common import materialise

    rows = packing.pack(materialise(pieces, "t"), 64).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r["id"], r["doc_tokens"], r["start"]), []).append(r)
    for i, t, _ in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 64):
            for r in whole[i, len(ids), s]:
                assert zlib.crc32(r["ids"]) == zlib.crc32(ids[s : s + 64].tobytes()) and r["length"] == len(ids[s : s + 64])
    by_window = {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_window.values():
        place = 0
        for offset, n in sorted(pieces):
            assert offset == place
            place += n
        assert place <= 64
    assert sum(n for p in by_window.values() for _, n in p) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in TEXTS)
    empty = packing.pack(materialise(packing.tokenised_pieces(no_docs, PATH), "t"))
    assert empty.count() == 0
