"""Conversation repair and chat formatting against brute force."""

import hashlib
import itertools
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import _ordered, chat_format, conversation_repair

from .conftest import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
CONVERSATIONS = [
    *[(1, i, r, f"{r} says {i}.") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])],
    *[(2, i, r, f"{r} {i}") for i, r in enumerate(["assistant", "assistant", "user"])],
    (3, 0, "user", ""), (3, None, "user", None), (3, 0, None, "who?"), (3, 5, "tool", "no. "),
    (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "Tie!"), (4, 1, None, None),
    *[(5, i, ("user", "assistant")[i % 2 ^ (i % 5 == 0)], f"text {i % 7}" + "." * (i % 3)) for i in range(9)],
    (None, None, None, None), (None, 3, "user", "a < b && c > d &lt; </turn>\n<turn>"),
    (6, 0, "user", "long " * 200_000 + "."), (6, 1, "assistant", "é🙂 & <text>!"),
    (7, 0, "", ""), (8, -5, "system", "s."), (8, 9, "user", "again."), (8, 9, "assistant", "so be it"),
]


def repaired(rows):
    """By trying ever dearer edits: a search over (row, roles so far) for the cheapest and then least audit."""
    fine = re.compile(r"(s?(ua)+)?")
    least = None

    def go(i, cost, audit, out):
        nonlocal least
        if least is not None and cost > least[0]:
            return
        roles = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and fine.fullmatch(roles) and (least is None or (cost, audit) < least[:2]):
            least = (cost, audit, list(out))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                dear = cost + 3 * (fault == "truncated")
                go(i + 1, dear, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, dear + 3, audit + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return least


def expected(conversations):
    found = {c: [] for c, *_ in conversations}
    for conv, turn, role, text in conversations:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            found[conv] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns, seen, marked, counts = [t for t, *_ in rows if t is not None], set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            cut = text.rstrip(WHITE)
            fault = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, made = repaired(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("conversations"))
    with_clashes(spark.createDataFrame(CONVERSATIONS, SCHEMA)).write.parquet(f"{at}/conversations.parquet")
    with_clashes(spark.createDataFrame([], SCHEMA)).write.parquet(f"{at}/none/conversations.parquet")
    return at


@pytest.mark.parametrize("bits", [12, 0, 1])
def test_repair_is_the_cheapest(spark, folder, monkeypatch, bits):
    # with fewer rows to a segment, all conversations take the way of long ones
    monkeypatch.setattr(_ordered, "ROW_BITS", bits)
    monkeypatch.setattr(conversation_repair, "FAN_BITS", 1)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.op11_conversation_repair(spark, folder).collect()}
    assert got == expected(CONVERSATIONS)


def test_repair_of_no_rows(spark, folder):
    assert conversation_repair.op11_conversation_repair(spark, f"{folder}/none").count() == 0
    # of a conversation whose only row is dropped
    conv = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "x")], SCHEMA).write.parquet(f"{folder}/dropped/conversations.parquet")
    row = conversation_repair.op11_conversation_repair(spark, f"{folder}/dropped").first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_maps_compose_to_the_whole(monkeypatch):
    # any cut of a row of turns gives the same least audit
    for initials in itertools.product("sua?", repeat=4):
        whole = conversation_repair.entered(0)
        for k, i in enumerate(initials):
            whole = conversation_repair.advance(whole, i, 3 * (k % 2))
        assert conversation_repair.best(whole)[1].count("I") <= 4
        rows = [(i + "x", "t", "truncated" if k % 2 else None) for k, i in enumerate(initials)]
        assert conversation_repair.best(whole) == repaired(rows)[:2]


@pytest.mark.parametrize("bits", [12, 1])
def test_chat_format_reads_back(spark, folder, monkeypatch, bits):
    monkeypatch.setattr(_ordered, "ROW_BITS", bits)
    said = r"\### Assistant: </turn> ok"
    conversations = [*CONVERSATIONS, (-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = {c: [] for c, *_ in conversations}
    for conv, turn, role, text in conversations:
        found[conv].append((turn, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        loss = "".join(t for _, r, t in rows if r == "assistant")
        e = lambda s: len(s) + 4 * s.count("&") + 3 * s.count("<")
        want[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss), sum(e(r) + e(t) + 20 for _, r, t in rows))
    assert {r[0]: tuple(r)[1:] for r in chat_format.op12_chat_format(spark, folder).collect()} == want


def test_chat_format_of_no_rows(spark, folder):
    assert [r[0] for r in chat_format.op12_chat_format(spark, f"{folder}/none").collect()] == [-7]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "S"}, {"role": "user", "content": "U"}, {"role": "assistant", "content": None}], "id": 5},
        {"conversations": [{"from": "human", "value": "U"}, {"from": "gpt", "value": "A", "weight": 1}]},
        {"prompt": "U", "completion": "A", "meta": {"role": "x"}},
        {"prompt": "U", "response": "A", "system": "S"},
        {"instruction": "I", "input": "more", "output": "A"},
        {"instruction": "I", "output": "A", "system": ""},
        {"question": "U", "answer": 7},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "U1"}, {"type": "text", "text": "U2"}]}]},
        {"message": {"author": {"role": "assistant"}, "content": {"parts": ["A", "B"]}}},
        {"role": "user", "text": "U"},
        {"role": "user", "content": "U"},
        {"messages": []},
        {"unknown": 1},
        ["no object"],
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "{broken"), (21, None)], "i int, r string")
    rows = chat_format.canonical_turns(df, "r", ["i"])
    got = {}
    for r in rows.orderBy("i", "n").collect():
        got.setdefault(r["i"], []).append((r["role"], r["text"]) if r["layout"] else None)
    assert got == {
        0: [("system", "S"), ("user", "U"), ("assistant", "")], 1: [("user", "U"), ("assistant", "A")], 2: [("user", "U"), ("assistant", "A")], 3: [("system", "S"), ("user", "U"), ("assistant", "A")],
        4: [("user", "I\nmore"), ("assistant", "A")], 5: [("user", "I"), ("assistant", "A")], 6: [("user", "U"), ("assistant", "7")], 7: [("user", "U1U2")], 8: [("assistant", "AB")],
        9: [("user", "U")], 10: [("user", "U")], 12: [None], 13: [None], 20: [None], 21: [None],
    }
    assert chat_format.unmapped(rows).agg(F.sum("records")).first()[0] == 4


def test_spans_lie_on_what_the_assistant_says(spark):
    record = json.dumps({"messages": [{"role": "user", "content": "<a>"}, {"role": "assistant", "content": "é & <b>"}, {"role": "assistant", "content": ""}]})
    row = chat_format.format_records(spark.createDataFrame([("k", 1, record), ("k", 0, record)], "key string, at int, r string"), "key", "at", "r").first()
    assert row["formatted"] == 2 * "<turn>user<text>&lt;a></turn>\n<turn>assistant<text>é &amp; &lt;b></turn>\n<turn>assistant<text></turn>\n"
    assert [row["formatted"][a:b] for a, b in row["loss"]] == 2 * ["é &amp; &lt;b>", ""]
