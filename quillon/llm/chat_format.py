r"""Chat formatting: records of unlike layouts become canonical turns, and those a text with a loss mask.

The field paths of a record (``messages[].content``) that some layout names are sorted
and hashed; the hash, its schema fingerprint, selects a declarative mapping (``LAYOUTS``).
A mapping says where the turns are, which field is the role and which the text, or
which fields stand for which roles. A layout with optional fields has a fingerprint for each choice of them.

The template writes a turn as ``<turn>role<text>text</turn>`` and a newline. In roles and texts ``&`` and
``<`` are written ``&amp;`` and ``&lt;``, so no text contains a control string and reading back restores it.
Spans, in code points of the written text, mark what the assistant says: the loss mask.

Conversations above the limits of ``_ordered`` are written as several parts, in order.

Defined results: null roles and texts are empty; records come by their order (nulls first), then by their
first turn's role and the SHA-256 of its text; a record that no layout fits, or that is no JSON object, gives one row with a null
turn and its fingerprint, and is left out of the text: ``unmapped`` counts them; an empty list of turns gives none;
fields that no layout names are ignored; records without a conversation are a conversation of their own; repeated rows
stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _ordered
from ._common import materialise


@dataclass(frozen=True)
class Layout:
    """Where a record of this kind keeps its turns.

    turns: path of the list of turns, None if the record is one turn. role and text: paths within a
    turn; a path that ends in [] is a list of texts, joined. Or fields: (role, path) of each turn's text, whose blank ones
    are left out if optional; paths joined by + make one text. names: other words for roles.
    """

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.fields:
            return [p for _, path in self.fields for p in path.split("+")]
        lead = f"{self.turns}[]." if self.turns else ""
        return [lead + self.role, lead + self.text]


SHARED = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn", role="role", text="text"),
    Layout("content turn", role="role", text="content"),
    Layout("from-value turn", role="from", text="value", names=SHARED),
    Layout("nested turn", role="message.author.role", text="message.content.parts[]"),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value", names=SHARED),
    Layout("message parts", turns="messages", role="role", text="content[].text"),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=("system", "input")),
)


def hashed(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[dict[str, Layout], frozenset[str]]:
    """Layout by fingerprint, and all the paths that layouts name."""
    known, named = {}, set()
    for layout in layouts:
        paths = layout.paths()
        named |= {*paths, *([f"{layout.turns}[]"] if layout.turns else [])}
        for n in range(len(layout.optional) + 1):
            for left_out in combinations(layout.optional, n):
                known.setdefault(hashed(p for p in paths if p not in left_out), layout)
        if layout.turns:
            known.setdefault(hashed([f"{layout.turns}[]"]), layout)
    return known, frozenset(named)


def _found(value, path: str) -> str:
    """The text at a path; null and missing are empty, other values as JSON writes them."""
    for i, step in enumerate(steps := path.split(".")):
        many = step.endswith("[]")
        value = value.get(step.removesuffix("[]")) if isinstance(value, dict) else None
        if many and isinstance(value, list):
            rest = ".".join(steps[i + 1 :])
            return "".join(_found(v, rest) if rest else _found({"": v}, "") for v in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    if layout.fields:
        out = []
        for role, path in layout.fields:
            text = "\n".join(filter(None, (_found(record, p) for p in path.split("+"))))
            if text or not set(path.split("+")) <= set(layout.optional):
                out.append((role, text))
        return out
    listed = [record]
    if layout.turns:
        listed = record.get(layout.turns) or []
    roles = [_found(t, layout.role) for t in listed]
    return [(layout.names.get(r, r), _found(t, layout.text)) for r, t in zip(roles, listed)]


def canonical_turns(records: DataFrame, record_col: str, keep: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """keep columns, n (place of the turn in its record), role, text, layout, fingerprint and head (role and text's digest of the record's first turn); one row per turn of each JSON record."""

    def run(batches):
        known, named = fingerprints(layouts)
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch[record_col]):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                paths = field_paths(record) if isinstance(record, dict) else set()
                mark = hashed(paths & named)
                layout = known.get(mark)
                if layout is None:
                    at.append(i)
                    out.append((None, None, None, None, hashed(paths), None))
                    continue
                found = turns_of(record, layout)
                head = f"{found[0][0]}\n{hashlib.sha256(found[0][1].encode()).hexdigest()}" if found else None
                for n, (role, said) in enumerate(found):
                    at.append(i)
                    out.append((n, role, said, layout.name, mark, head))
            made = pd.DataFrame(out, columns=["n", "role", "text", "layout", "fingerprint", "head"]).astype({"n": "Int64"})
            yield pd.concat([batch[keep].iloc[at].reset_index(drop=True), made], axis=1)

    kinds = dict(records.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return records.select(*keep, record_col).mapInPandas(run, f"{schema}, n long, role string, text string, layout string, fingerprint string, head string")


def unmapped(turns: DataFrame) -> DataFrame:
    """(fingerprint, records): layouts that want a mapping."""
    return turns.filter("layout IS NULL").groupBy("fingerprint").agg(F.count("*").alias("records"))


#: Control strings of the template; what is said before and after them is escaped.
OPEN, SAYS, END = "<turn>", "<text>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_turns(turns: DataFrame, key: str = "key", seg: str = "seg", order: tuple[str, ...] = ()) -> DataFrame:
    """(key, seg, formatted, loss): a row per segment, loss an array of (start, end) in code points of formatted.

    turns: role and text besides key, seg and order. A segment is bounded (see ``_ordered``), so one row can hold it.
    """
    lead = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit(SAYS))
    said = escaped(F.coalesce("text", F.lit("")))
    place = [c for o in order for c in (F.col(o).isNotNull().alias(f"{o}_given"), F.col(o).alias(o))]
    row = F.struct(*place, F.concat(lead, said, F.lit(END)).alias("block"), F.when(F.col("role") == "assistant", F.struct(F.length(lead).alias("start"), (F.length(lead) + F.length(said)).alias("end"))).alias("span"))
    rows = turns.groupBy(key, seg).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))

    def add(acc, r):
        moved = F.struct((acc["at"] + r["span"]["start"]).alias("start"), (acc["at"] + r["span"]["end"]).alias("end"))
        return F.struct((acc["at"] + F.length(r["block"])).alias("at"), F.when(r["span"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(moved))).alias("spans"))

    loss = F.aggregate("rows", start, add)["spans"]
    return rows.select(key, seg, F.array_join(F.transform("rows", lambda r: r["block"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a written text, an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescaped(F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.length(b)), SAYS, 1)).alias("role"), unescaped(F.substring_index(b, SAYS, -1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, an array."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_records(records: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """(key, seg, formatted, loss) of JSON records; key is text and not null, order their place in it."""
    rows = records.select(key, order, record, F.monotonically_increasing_id().alias("row"))
    over = _ordered.long_keys(rows, key, F.lit(1), F.octet_length(record))
    place = lambda df: canonical_turns(df, record, [key, order, "row"]).filter("layout IS NOT NULL")
    by = (order, "head", "row", "n")  # the turns of a record stay together
    turns = place(rows.join(over, key, "left_anti")).withColumn("seg", F.lit(0).cast("long"))
    out = format_turns(turns, key, "seg", by)
    if not over.isEmpty():
        more = _ordered.segmented(place(rows.join(over, key, "left_semi")), key, list(by))
        out = out.unionByName(format_turns(more, key, "seg", ("seq",)))
    return out


def as_records(conversations: DataFrame) -> DataFrame:
    """(key, turn, record): rows as JSON records in the layouts of three exports, dealt by a hash of conversation and turn."""
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    whole = {"ignoreNullFields": "false"}
    flat = F.to_json(F.struct("role", "text"), whole)
    theirs = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    shared = F.to_json(F.struct(theirs.alias("from"), F.col("text").alias("value")), whole)
    nested = F.to_json(F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message")), whole)
    record = F.when((kind == 1) & F.col("role").isin("user", "assistant", "system"), shared).when(kind == 2, nested).otherwise(flat)
    return conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "turn", record.alias("record"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    parts = format_records(as_records(table.unionByName(more)), "key", "turn", "record")
    turns, loss = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")
    read = parts.select("key", "seg", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").alias("formatted_chars"))
    read = read.select("key", "seg", F.size("turns").alias("n_turns"), F.array_join(turns, "").alias("turns"), "loss", F.length("loss").alias("loss_chars"), "formatted_chars")
    short = read.filter("seg = 0").select("key", F.col("n_turns").cast("long"), F.sha2("turns", 256).alias("turns_sha256"), F.col("loss_chars").cast("long"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
    long = materialise(read.filter("seg > 0").select("key", "seg", "n_turns", F.col("turns").cast("binary"), F.col("loss").cast("binary"), "loss_chars", "formatted_chars"), "read-back")
    sums = long.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")])
    out = short.unionByName(sums.join(_ordered.digests(long, "key", ["seg"], ["turns", "loss"]), "key").select(*short.columns))
    return out.select(F.when(F.col("key") != " ", F.col("key").cast("long")).alias("conv_id"), *[c for c in out.columns if c != "key"])


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)),
written AS (SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS e, replace(replace(role, '&', '&amp;'), '<', '&lt;') AS er FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(e) + 20)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
