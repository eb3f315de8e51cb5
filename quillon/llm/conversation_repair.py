"""Repair of conversations whose turns were lost, emptied, cut, repeated or mislabelled.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A
forward Viterbi dynamic program walks its rows over four grammar states (nothing
yet, after system, after user, after assistant) and carries for each the least
(cost, audit string). A row is kept (K, 0), given another role (R, 3) or deleted (D, 4);
blank and duplicate rows must go, truncated rows that stay cost 3 more. Each row's layer
is closed with insert transitions (I, 3), of which two in a row are all that can pay.
Audits of equal cost are never prefixes of each other, as equal letters cost the same, so
the least string of a state stays least whatever follows.

Rows of a short conversation meet in one task. One above the limits of ``_ordered`` is cut into
segments: each yields its map from entry state to exit state, (cost, audit); maps are
composed 256 at a time and then along the conversation, and the segments are repaired
side by side once their entry states are known.

Defined results: null roles and texts are one space; rows come by turn (nulls first), then
role, then the SHA-256 of the text; a role counts by its initial, so one that starts with none of s, u
and a is given another or deleted; rows without a conversation are a conversation of their own;
repeated rows are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _ordered
from ._common import materialise
from ._pairs import runs

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: State after a turn of that initial; what is missing here is no turn that the grammar allows.
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTS = ((0, 2), (1, 2), (2, 3), (3, 2))
NAMES = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
#: Segments whose maps one task composes.
FAN_BITS = 8

Layer = list[tuple[int, str] | None]


def _offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """In this order of states, two inserts in a row are found in one pass."""
    for a, b in INSERTS:
        if layer[a]:
            _offer(layer, b, layer[a][0] + 3, layer[a][1] + "I")
    return layer


def entered(state: int) -> Layer:
    return closed([(0, "") if s == state else None for s in range(4)])


def advance(layer: Layer, initial: str, fault: int) -> Layer:
    out: Layer = [None] * 4
    stay = 3 if fault == TRUNCATED else 0
    for state, held in enumerate(layer):
        if held is None:
            continue
        cost, audit = held
        _offer(out, state, cost + 4, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        for role in "sua":
            to = GOES.get((state, role))
            if to is not None and role == initial:
                _offer(out, to, cost + stay, audit + "K")
            elif to is not None and role != "s":
                _offer(out, to, cost + stay + 3, audit + "R")
    return closed(out)


def best(layer: Layer) -> tuple[int, str]:
    return min(layer[s] for s in ACCEPTED if layer[s])


def replay(audit: str, state: int, rows) -> list[tuple[str, str]]:
    """(role, text) of what an audit makes of rows, an iterator of (role, text), from a state on."""
    out = []
    for edit in audit:
        if edit == "I":
            state = 3 if state == 2 else 2
            out.append((NAMES[state], ""))
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            state = 3 if state == 2 else 2
            role = NAMES[state]
        else:
            state = GOES[(state, role[:1])]
        out.append((role, text))
    return out


@dataclass
class Repair:
    """summary: a row per conversation. turns: (key, seg, turns), what stays, an array of (role, text) for each segment."""

    summary: DataFrame
    turns: DataFrame


def _rows(batches, columns: tuple[str, ...]):
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in columns))


def _short(batches):
    """Whole conversations; their rows come sorted by key and order."""
    out = []
    for key, rows in groupby(_rows(batches, ("key", "role", "text", "fault")), itemgetter(0)):
        layer, seen, previous, kept = entered(0), set(), None, []
        counts, illegal = [0] * 4, 0
        for _, role, text, fault in rows:
            row, initial = (role, text), role[:1]
            if fault != BLANK:
                fault = DUPLICATE if row in seen else fault
                seen.add(row)
            counts[fault] += 1
            illegal += previous is not None and previous + initial not in LEGAL
            layer, previous = advance(layer, initial, fault), initial
            kept.append(row)
        cost, audit = best(layer)
        out.append((key, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit, [{"role": r, "text": t} for r, t in replay(audit, 0, iter(kept))]))
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=SHORT_COLUMNS)
            out = []
    yield pd.DataFrame(out, columns=SHORT_COLUMNS)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
SHORT_COLUMNS = ["key", *COUNTS, "cost", "audit", "turns"]
SHORT_SCHEMA = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>"
#: costs and audits by 4 * entry + exit, cost null where there is no way; segs: the segments composed, paths: their exit states.
MAP_SCHEMA = "key string, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>, segs array<long>, paths array<string>"


def _segment_maps(batches):
    """Rows of segments, sorted by group and seq: (group, key, seg, initial, fault)."""
    for frame in runs(batches, "group"):
        layers = [entered(s) for s in range(4)]
        initials, faults = frame["initial"].tolist(), frame["fault"].tolist()
        for initial, fault in zip(initials, faults):
            layers = [advance(layer, initial, fault) for layer in layers]
        cells = [c for layer in layers for c in layer]
        counts = {name: faults.count(code) for name, code in zip(COUNTS, (BLANK, DUPLICATE, TRUNCATED))}
        seg = int(frame["seg"].iloc[0])
        yield pd.DataFrame(
            {"key": [frame["key"].iloc[0]], "seg": seg, **counts, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
             "costs": [[c[0] if c else None for c in cells]], "audits": [[c[1] if c else None for c in cells]], "segs": [[seg]], "paths": [[str(i % 4) for i in range(16)]]}
        )


def _composed(batches):
    """One map for each group, from maps sorted by group and seg."""
    for frame in runs(batches, "group"):
        out = None
        for row in frame.itertuples():
            costs = [None if c is None or c != c else int(c) for c in row.costs]
            part = {"costs": costs, "audits": list(row.audits), "paths": list(row.paths), "segs": list(row.segs), "first": row.first, "last": row.last, **{c: int(getattr(row, c)) for c in COUNTS}}
            if out is None:
                out = part
                continue
            cells = [None] * 16
            for entry in range(4):
                for mid in range(4):
                    a = 4 * entry + mid
                    if out["costs"][a] is None:
                        continue
                    for exit_ in range(4):
                        b = 4 * mid + exit_
                        if costs[b] is None:
                            continue
                        cell = (out["costs"][a] + costs[b], out["audits"][a] + part["audits"][b], out["paths"][a] + part["paths"][b])
                        if cells[4 * entry + exit_] is None or cell < cells[4 * entry + exit_]:
                            cells[4 * entry + exit_] = cell
            for k, name in enumerate(("costs", "audits", "paths")):
                out[name] = [c[k] if c else None for c in cells]
            out["illegal"] += out["last"] + part["first"] not in LEGAL
            for c in COUNTS:
                out[c] += part[c]
            out["segs"] += part["segs"]
            out["last"] = part["last"]
        yield pd.DataFrame({"key": [frame["key"].iloc[0]], "seg": frame["seg"].iloc[0], **{k: [v] for k, v in out.items()}})[[c.split()[0] for c in MAP_SCHEMA.split(", ")]]


def _compose(maps: DataFrame, group: Column) -> DataFrame:
    dealt = maps.withColumn("group", group).repartition("group").sortWithinPartitions("group", "key", "seg")
    return materialise(dealt.mapInPandas(_composed, MAP_SCHEMA), "maps")


def _replayed(batches):
    """Sorted by group and seq, each group headed by the row that holds its audit and entry state."""
    held, group = [], None

    def done():
        if group is None:
            return []
        head, rows = held[0], held[1:]
        return [(head[0], head[1], [{"role": r, "text": t} for r, t in replay(head[2], int(head[3]), iter(rows))])]

    for batch in batches:
        out = []
        for g, key, seg, audit, entry, role, text in zip(*(batch[c] for c in ("group", "key", "seg", "audit", "entry", "role", "text"))):
            if g != group:
                out += done()
                held, group = [(key, seg, audit, entry)], g
            else:
                held.append((role, text))
        yield pd.DataFrame(out, columns=["key", "seg", "turns"])
    yield pd.DataFrame(done(), columns=["key", "seg", "turns"])


def _long(rows: DataFrame) -> Repair:
    """Conversations above the limits."""
    rows = _ordered.segmented(rows, "key", ["turn", "role", "text_id", "row"])
    first = rows.groupBy("key", "role", "text_id").agg(F.min("seq").alias("first_seq")).select("first_seq")
    fault = F.when((F.col("fault") != BLANK) & F.col("first_seq").isNull(), DUPLICATE).otherwise(F.col("fault"))
    # joined by places, which are unique: a text that repeats makes no hot key
    marked = rows.select("key", "seg", "seq", F.substring("role", 1, 1).alias("initial"), "fault").join(first, F.col("seq") == F.col("first_seq"), "left")
    group = F.sha2(F.concat_ws(":", "key", F.col("seg").cast("string")), 256)
    marked = marked.select(group.alias("group"), "key", "seg", "seq", "initial", fault.alias("fault"))
    maps = materialise(marked.repartition("group").sortWithinPartitions("group", "seq").mapInPandas(_segment_maps, MAP_SCHEMA), "maps")
    whole = _compose(_compose(maps, F.concat_ws(":", "key", F.shiftright("seg", FAN_BITS).cast("string"))), F.col("key"))

    exits = [F.when(F.get("costs", F.lit(s)).isNotNull(), F.struct(F.get("costs", F.lit(s)).alias("cost"), F.get("audits", F.lit(s)).alias("audit"), F.get("paths", F.lit(s)).alias("path"))) for s in ACCEPTED]
    whole = whole.withColumn("won", F.least(*exits))
    summary = whole.select("key", *COUNTS, "won.cost", "won.audit")
    path = F.concat(F.lit("0"), "won.path")
    ways = whole.select("key", F.posexplode("segs").alias("i", "seg"), path.alias("path"))
    ways = ways.select("key", "seg", F.substring(F.col("path"), F.col("i") + 1, F.lit(1)).cast("int").alias("entry"), F.substring(F.col("path"), F.col("i") + 2, F.lit(1)).cast("int").alias("exit"))
    heads = ways.join(maps.select("key", "seg", "audits"), ["key", "seg"]).select("key", "seg", F.lit(-1).cast("long").alias("seq"), F.get("audits", 4 * F.col("entry") + F.col("exit")).alias("audit"), "entry", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = rows.select("key", "seg", "seq", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("entry"), "role", "text")
    dealt = heads.unionByName(body).withColumn("group", group).repartition("group").sortWithinPartitions("group", "seq")
    return Repair(summary, dealt.mapInPandas(_replayed, "key string, seg long, turns array<struct<role: string, text: string>>"))


def repair(rows: DataFrame) -> Repair:
    """rows: key, turn, role, text, none of them null but for turn."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    rows = rows.select("key", "turn", "role", "text", F.sha2("text", 256).alias("text_id"), F.monotonically_increasing_id().alias("row"), fault.alias("fault"))
    over = _ordered.long_keys(rows, "key", F.lit(1), F.octet_length("text"))
    short = rows.join(over, "key", "left_anti").repartition("key").sortWithinPartitions("key", "turn", "role", "text_id")
    done = materialise(short.select("key", "role", "text", "fault").mapInPandas(_short, SHORT_SCHEMA), "repaired")
    summary, turns = done.drop("turns"), done.select("key", F.lit(0).cast("long").alias("seg"), "turns")
    if not over.isEmpty():
        more = _long(rows.join(over, "key", "left_semi"))
        summary, turns = summary.unionByName(more.summary), turns.unionByName(more.turns)
    return Repair(summary, turns)


def gaps(rows: DataFrame) -> DataFrame:
    """(key, gaps): turns missing between the least and the largest one of a conversation. rows: key, turn."""
    once = rows.filter("turn IS NOT NULL").select("key", "turn").distinct()
    return once.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text): rows as a checksum of conversation and turn spoils them; key is the conversation's id as text, one space for null."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(kind == 4, "user").otherwise(as_text("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(kind != 0).select(as_text("conv_id").alias("key"), "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    done = repair(rows)
    # newline-joined: all lines of a conversation but the first are led by a newline
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    short = done.turns.filter("seg = 0").select("key", F.sha2(F.array_join(lines, "\n"), 256).alias("payload_sha256"))
    later = done.turns.filter("seg > 0 AND size(turns) > 0").select("key", "seg", F.concat(F.lit("\n"), F.array_join(lines, "\n")).alias("payload"))
    first = later.groupBy("key").agg(F.min("seg").alias("first"))
    later = later.join(first, "key").select("key", "seg", F.when(F.col("seg") == F.col("first"), F.expr("substring(payload, 2)")).otherwise(F.col("payload")).cast("binary").alias("payload"))
    hashes = short.unionByName(_ordered.digests(later, "key", ["seg"], ["payload"]))
    known = done.summary.join(hashes, "key", "left").join(gaps(rows), "key", "left")
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return ids.join(known, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("payload_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
named AS (SELECT DISTINCT name, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT) AS bytes FROM keyed),
sums AS (
  SELECT name, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
           list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM named),
spoilt AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM keyed JOIN sums USING (name), unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS c(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
         row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS cut, role[1] AS initial FROM spoilt),
faulty AS (
  SELECT *, CASE WHEN cut = '' THEN 1 WHEN nth > 1 THEN 2 WHEN cut[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY key ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS bad FROM placed),
convs AS (
  SELECT key, list({'i': initial, 'f': fault, 'role': role, 'text': text} ORDER BY pos) AS rows, count(*) AS n,
         max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM faulty GROUP BY key),
-- each layer: the least of (cost, audit, repaired lines) in four states; cost 1e9 where there is no way
dp AS (
  SELECT key, 0 AS step, n, rows, {'c': 0, 'a': '', 'l': ''} AS s0, {'c': 1000000000, 'a': '', 'l': ''} AS s1,
         {'c': 3, 'a': 'I', 'l': E'\nuser:'} AS s2, {'c': 6, 'a': 'II', 'l': E'\nuser:\nassistant:'} AS s3 FROM convs
  UNION ALL
  SELECT key, step + 1, n, rows, e0 AS s0, e1 AS s1,
         list_min([e2, {'c': e0.c + 3, 'a': e0.a || 'I', 'l': e0.l || E'\nuser:'}, {'c': e1.c + 3, 'a': e1.a || 'I', 'l': e1.l || E'\nuser:'}, {'c': e3.c + 3, 'a': e3.a || 'I', 'l': e3.l || E'\nuser:'}]) AS s2,
         list_min([e3, {'c': e2.c + 3, 'a': e2.a || 'I', 'l': e2.l || E'\nassistant:'}, {'c': e0.c + 6, 'a': e0.a || 'II', 'l': e0.l || E'\nuser:\nassistant:'}, {'c': e1.c + 6, 'a': e1.a || 'II', 'l': e1.l || E'\nuser:\nassistant:'}]) AS s3
  FROM (
    SELECT key, step, n, rows, {'c': s0.c + 4, 'a': s0.a || 'D', 'l': s0.l} AS e0,
           list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 'l': s1.l}] || CASE WHEN f IN (0, 3) AND i = 's' THEN [{'c': s0.c + f, 'a': s0.a || 'K', 'l': s0.l || own}] ELSE [] END) AS e1,
           list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 'l': s2.l}] || CASE WHEN f IN (1, 2) THEN [] ELSE
             [{'c': s0.c + f + u, 'a': s0.a || eu, 'l': s0.l || lu}, {'c': s1.c + f + u, 'a': s1.a || eu, 'l': s1.l || lu}, {'c': s3.c + f + u, 'a': s3.a || eu, 'l': s3.l || lu}] END) AS e2,
           list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 'l': s3.l}] || CASE WHEN f IN (1, 2) THEN [] ELSE [{'c': s2.c + f + a, 'a': s2.a || ea, 'l': s2.l || la}] END) AS e3
    FROM (
      SELECT *, r.f AS f, r.i AS i, E'\n' || r.role || ':' || r.text AS own, CASE WHEN r.i = 'u' THEN 0 ELSE 3 END AS u, CASE WHEN r.i = 'a' THEN 0 ELSE 3 END AS a,
             CASE WHEN r.i = 'u' THEN 'K' ELSE 'R' END AS eu, CASE WHEN r.i = 'a' THEN 'K' ELSE 'R' END AS ea,
             E'\n' || CASE WHEN r.i = 'u' THEN r.role ELSE 'user' END || ':' || r.text AS lu, E'\n' || CASE WHEN r.i = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text AS la
      FROM (SELECT *, rows[step + 1] AS r FROM dp WHERE step < n)))),
won AS (SELECT key, list_min([s0, s3]) AS w FROM dp WHERE step = n),
ids AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.l[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN convs USING (key) LEFT JOIN won USING (key)
"""
