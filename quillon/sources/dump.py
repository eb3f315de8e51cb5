"""SQL scripts of any size as rows: one script is read by many tasks.

What a character means depends on all quotes before it. So each split of a file first
becomes a map, from the state at its start (outside, in a quoted text or name, in a comment) to the state at its end
and the number of statements that end in it; the maps of a file are composed in order, which gives each split
its true state, and the splits are cut into statements side by side. A statement that spans splits is put together from its pieces.

A statement must fit a row; quotes within texts are doubled or, with ``backslash``, escaped. A last statement without its end counts; one that is blank or
only comments doesn't. Lines end with a line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import pinned

OUTSIDE, SINGLE, DOUBLE, BACK, LINE, BLOCK = range(6)
OPENS = {"'": SINGLE, '"': DOUBLE, "`": BACK, "--": LINE, "/*": BLOCK}
ENDS = {SINGLE: "'", DOUBLE: '"', BACK: "`", LINE: "\n", BLOCK: "*/"}
_OUT = re.compile(r"['\"`;]|--|/\*")


def scan(text: str, state: int, backslash: bool = False) -> tuple[int, list[int]]:
    """(state at the end, places behind the semicolons that end statements). A doubled quote closes a text and opens it again, which comes to the same."""
    at, cuts = 0, []
    while True:
        if state == OUTSIDE:
            m = _OUT.search(text, at)
            if not m:
                return state, cuts
            at = m.end()
            if m[0] == ";":
                cuts.append(at)
            else:
                state = OPENS[m[0]]
        else:
            end = ENDS[state]
            found = text.find(end, at)
            while backslash and state in (SINGLE, DOUBLE) and found >= 0 and _escaped(text, found, at):
                found = text.find(end, found + 1)
            if found < 0:
                return state, cuts
            at, state = found + len(end), OUTSIDE


def _escaped(text: str, at: int, least: int) -> bool:
    n = 0
    while at - n - 1 >= least and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def statements(spark: SparkSession, path: str, backslash: bool = False) -> DataFrame:
    """(file, ordinal, statement) of the scripts at a path, in any split: ordinal counts a file's statements from 0."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
        """Runs of lines of one block, each with its line feeds."""
        for batch in batches:
            for (file, block), rows in batch.groupby(["file", "block"], sort=False):
                yield file, int(block), "\n".join(rows["value"]) + "\n"

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for file, block, text in chunks(batches):
            now = held.setdefault((file, block), [(s, 0) for s in range(6)])
            known: dict[int, tuple[int, int]] = {}
            for i, (state, n) in enumerate(now):
                if state not in known:
                    end, cuts = scan(text, state, backslash)
                    known[state] = (end, len(cuts))
                now[i] = (known[state][0], n + known[state][1])
        yield pd.DataFrame([(f, b, [s for s, _ in m], [n for _, n in m]) for (f, b), m in held.items()], columns=["file", "block", "exits", "counts"])

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per split, sorted by file and block: its state and the statements before it."""
        file, state, n = None, OUTSIDE, 0
        for batch in batches:
            out = []
            for f, block, exits, counts in zip(batch["file"], batch["block"], batch["exits"], batch["counts"]):
                if f != file:
                    file, state, n = f, OUTSIDE, 0
                out.append((f, block, state, n))
                state, n = int(exits[state]), n + int(counts[state])
            yield pd.DataFrame(out, columns=["file", "block", "state", "before"])

    lines = pinned(lines)  # both passes see the same splits
    found = lines.mapInPandas(maps, "file string, block long, exits array<int>, counts array<long>")
    entry = found.repartition("file").sortWithinPartitions("file", "block").mapInPandas(composed, "file string, block long, state int, before long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple[str, int], tuple[int, int]] = {}
        piece: dict[tuple[str, int], int] = {}
        for batch in batches:
            out = []
            for (file, block), rows in batch.groupby(["file", "block"], sort=False):
                at = (file, int(block))
                state, ordinal = now.get(at, (int(rows["state"].iloc[0]), int(rows["before"].iloc[0])))
                text = "\n".join(rows["value"]) + "\n"
                state, cuts = scan(text, state, backslash)
                for a, b in zip([0, *cuts], [*cuts, len(text)]):
                    piece[at] = piece.get(at, 0) + 1
                    out.append((file, ordinal, at[1], piece[at], text[a:b]))
                    ordinal += 1
                ordinal -= 1
                now[at] = (state, ordinal)
            yield pd.DataFrame(out, columns=["file", "ordinal", "block", "piece", "text"])

    led = lines.join(entry, ["file", "block"])
    pieces = led.repartition("file", "block").sortWithinPartitions("file", "block", "n").select("file", "block", "n", "value", "state", "before")
    pieces = pieces.mapInPandas(cut, "file string, ordinal long, block long, piece long, text string")
    whole = pieces.groupBy("file", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))), lambda p: p["text"]), "").alias("statement"))
    trimmed = F.trim(F.regexp_replace("statement", r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"^(?:\s*(?:--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/))+", ""), r"^[\s;]+$", "")
    return whole.filter(F.trim(F.regexp_replace(bare, r"\s+", " ")) != "").select("file", "ordinal", trimmed.alias("statement"))


_HEAD = re.compile(r"\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*INSERT\s+(?:OR\s+\w+\s+)?INTO\s+([\"`\[]?)([^\"`\]\s(]+)[\"`\]]?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I | re.S)
_VALUE = re.compile(r"\s*(?:([xX]?)'((?:[^'\\]|''|\\.)*)'|([^\s,()']+(?:\([^()]*\))?))\s*([,)])", re.S)
_PLAIN = re.compile(r"\s*(?:([xX]?)'((?:[^']|'')*)'|([^\s,()']+(?:\([^()]*\))?))\s*([,)])", re.S)
#: What a backslash and a letter stand for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}


def inserted(statement: str, backslash: bool = False) -> tuple[str, list[str] | None, list[list[str | None]]] | None:
    """(table, columns, rows of texts) of an INSERT ... VALUES statement; NULL is None, binary literals keep their X'..' form. None for other statements and those that can't be read."""
    head = _HEAD.match(statement)
    if not head:
        return None
    columns = [c.strip().strip("\"`[]") for c in head[3].split(",")] if head[3] else None
    value, at, rows = _VALUE if backslash else _PLAIN, head.end(), []
    while at < len(statement) and statement[at] == "(":
        at, row = at + 1, []
        while True:
            m = value.match(statement, at)
            if not m:
                return None
            at = m.end()
            if m[2] is not None:
                text = m[2].replace("''", "'")
                text = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), text, flags=re.S) if backslash else text
                row.append(f"X'{text}'" if m[1] else text)
            else:
                row.append(None if m[3].upper() == "NULL" else m[3])
            if m[4] == ")":
                break
        rows.append(row)
        more = re.compile(r"\s*,\s*").match(statement, at)
        if not more:
            break
        at = more.end()
    return head[2], columns, rows


def rows_of(script: DataFrame, table: str, schema: T.StructType | str, backslash: bool = False) -> DataFrame:
    """Rows that the INSERT statements of a script put into a table, as schema; values that don't fit are null, and so are columns that a statement leaves out."""
    found = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = found.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for statement in batch["statement"]:
                read = inserted(statement, backslash)
                if read and read[0].lower() == table.lower():
                    at = {c.lower(): i for i, c in enumerate(read[1] or names)}
                    out += [([row[at[n.lower()]] if n.lower() in at and at[n.lower()] < len(row) else None for n in names],) for row in read[2]]
            yield pd.DataFrame(out, columns=["v"])

    rows = script.select("statement").mapInPandas(run, "v array<string>")
    cast = []
    for i, f in enumerate(found.fields):
        v, kind = F.get("v", F.lit(i)), f.dataType.simpleString()
        if kind == "binary":
            v = F.unhex(F.regexp_extract(v, r"^X'([0-9A-Fa-f]*)'$", 1))
        elif kind.startswith("array"):
            v = F.from_json(v, f.dataType)
        else:
            v = v.try_cast(f.dataType)
        cast.append(v.alias(f.name))
    return rows.select(*cast)


def written(df: DataFrame, table: str) -> DataFrame:
    """(value): df as INSERT statements, one a row, for ``write.text``."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    out = []
    for c, t in df.dtypes:
        v = F.col(f"`{c}`")
        if t.startswith("array"):
            v = quote(F.to_json(v))
        elif t == "binary":
            v = F.concat(F.lit("X'"), F.hex(v), F.lit("'"))
        elif t in ("int", "bigint", "double", "float", "boolean") or t.startswith("decimal"):
            v = v.cast("string")
        else:
            v = quote(v.cast("string"))
        out.append(F.coalesce(v, F.lit("NULL")))
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *out), F.lit(");")).alias("value"))
