"""Secret scanning over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any
match must contain, as alternatives of sets. Postings (trigram, document) are
intersected by counting a document's hits per set. Only candidates are read again and
verified with the expression itself; rules without a mandatory trigram scan all texts.
All of it is DataFrame expressions.

``TrigramIndex`` keeps the postings of all trigrams in a table, for any rules and many
scans. A single scan would read more for building it than it saves, so without an index
the scan makes the postings of the trigrams that its rules ask for, and of no others.

Matches are leftmost and do not overlap within a rule. Their places follow from the
gaps between them: prefix sums over the lengths of gaps and matches.

Defined results: null and empty texts have no spans; rows that repeat an id and a
text get the same spans, once each; an empty table gives no rows; extra columns are
not read. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BucketedTable, materialise


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    # maximal runs, so that a least length inside the pattern finds the same matches
    Rule("access", r"AKIA[A-Z0-9]{16,}", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    # from the border of a run on, and possessive: a run is read once, however often it holds the beginning
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
)

Query = frozenset  # of alternatives, each a frozenset of trigrams that must all occur
ANYTHING: Query = frozenset([frozenset()])
MOST = 64


def _simpler(q: set) -> Query:
    """Without alternatives that contain another one."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _all(a: Query, b: Query) -> Query:
    both = _simpler({x | y for x in a for y in b})
    return both if len(both) <= MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _simpler({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _exact(node) -> set[str] | None:
    """The strings that a node matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, v in arg:
            if kind is sre.LITERAL:
                out.add(chr(v).lower())
            elif kind is sre.RANGE and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.AT:
        return {""}
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_sequence(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one = _exact_sequence(arg[2])
        if one is not None:
            out, run = set(), {""}
            for k in range(arg[1] + 1):
                out |= run if k >= arg[0] else set()
                run = {a + b for a in run for b in one}
                if len(run) > MOST:
                    return None
            return out
    return None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(part) * len(out) > MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _sequence_query(nodes) -> Query:
    out, run = ANYTHING, {""}
    for node in nodes:
        part = _exact(node)
        if part is not None and len(part) * len(run) <= MOST:
            run = {a + b for a in run for b in part}
            continue
        out, run = _all(out, _of_strings(run)), {""}
        op, arg = node
        if part is not None:
            run = part
        elif op is sre.SUBPATTERN:
            out = _all(out, _sequence_query(arg[-1]))
        elif op is sre.BRANCH:
            out = _all(out, _simpler(set().union(*[_sequence_query(b) for b in arg[1]])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out = _all(out, _sequence_query(arg[2]))
    return _all(out, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams: each match of pattern contains all of one. ANYTHING if it need not contain any."""
    return _sequence_query(_parser.parse(pattern))


def _key(id_col: str, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.col(id_col).isNull().cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)))


def wanted_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for alternative in trigram_query(r.pattern) for t in alternative})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trigrams: list[str] | None = None) -> DataFrame:
    """Postings (trigram, key), distinct: all trigrams of the lower-cased texts, or the given ones alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col, text).alias("key"), F.lower(text).alias("low"))
    if trigrams is None:
        seen = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))  # a look-ahead, as trigrams overlap
    elif trigrams:
        # the lower-cased text is an element of an array here, so that it is made once and not for each trigram
        every = F.array(*map(F.lit, trigrams))
        seen = F.transform(F.array("low"), lambda low: F.filter(every, lambda t: F.contains(low, t)))[0]
    else:
        seen = F.array().cast("array<string>")
    rows = rows.select("key", seen.alias("seen")).filter(F.size("seen") > 0)
    return rows.select(F.explode("seen").alias("trigram"), "key").distinct()


class TrigramIndex(BucketedTable):
    """A persistent index of all trigrams, at a path: bucketed and sorted by trigram; later sessions open it by that path.

    It serves any rules, later ones too: a query reads the buckets and row groups of its trigrams
    alone. Documents are indexed once; those that are there already add nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, "trigram string, key binary", "trigram", buckets)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        fresh = build_index(docs, id_col, text_col).join(self.table().hint("merge"), ["trigram", "key"], "left_anti")
        # salted: a frequent trigram has a posting in nearly every document, and its bucket is written by several tasks
        self.append(fresh.repartition(4 * self.buckets, "trigram", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("trigram"))

    def postings(self, trigrams: list[str]) -> DataFrame:
        return self.table().filter(F.col("trigram").isin(*trigrams))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): documents whose postings satisfy the queries of these rules."""

    def holds(rule: Rule) -> Column:
        sets = [F.count_if(F.col("trigram").isin(*sorted(s))) == len(s) for s in trigram_query(rule.pattern)]
        out = sets[0]
        for s in sets[1:]:
            out = out | s
        return F.when(out, F.lit(rule.kind))

    found = postings.groupBy("key").agg(*[holds(r).alias(f"__{i}") for i, r in enumerate(rules)])
    kinds = F.array_compact(F.array(*[F.col(f"__{i}") for i in range(len(rules))]))
    return found.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


#: Bits of a bitmap, bits for each candidate, and bitmaps that are broadcast at most, 4 KB each.
BITS, PER_CANDIDATE, BITMAPS = 32_768, 16, 8192


def _may_be(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those rows whose key may be one of chosen's: a filter of hashed bits, so that few texts that are no candidates move.

    The bitmaps are 32 MB at most, whatever the number of candidates; a join must follow, as other keys may share a bit.
    """
    bitmaps = min(BITMAPS, max(1, -(-PER_CANDIDATE * chosen.count() // BITS)))
    place = F.pmod(F.xxhash64("key"), F.lit(bitmaps * BITS))
    marked = chosen.select(place.alias("place")).groupBy(F.floor(F.col("place") / BITS).alias("map")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITS))).alias("bits"))
    bit = F.pmod("place", F.lit(BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(byte, bit % 8) & 1 = 1")
    met = rows.withColumn("place", place).join(F.broadcast(marked), F.floor(F.col("place") / BITS) == F.col("map"))
    return met.withColumn("bit", bit).withColumn("byte", byte).filter(set_).select(*rows.columns)


def _matches(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows: (key, text). (key, kind, pos, gap, size, part) for every match, failing ones too."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    hit = rows.filter(F.col("text").rlike(pattern))
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    parts = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group))
    each = hit.select("key", F.posexplode(F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(gaps, F.length).alias("gap"), F.transform(parts, F.length).alias("part"))).alias("pos", "m"))
    # the last gap follows the last match, and has none of its own
    return each.filter("m.size IS NOT NULL").select("key", F.lit(rule.kind).alias("kind"), "pos", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"), F.col("m.part").alias("part"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, index: TrigramIndex | None = None) -> DataFrame:
    """(key, spans): an array of (start, rank, end, kind) in order, for each document with a secret; rank is the rule's place.

    Postings come from the index, which must hold these documents, or else from a pass over
    the texts for the trigrams that the rules ask for.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANYTHING)
    plain = tuple(r for r in rules if r not in indexed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col, text).alias("key"), text.alias("text"))
    parts = [_matches(rows, r) for r in plain]
    if indexed:
        wanted = wanted_trigrams(indexed)
        postings = index.postings(wanted) if index else materialise(build_index(docs, id_col, text_col, wanted), "postings")
        met = materialise(candidates(postings, indexed), "met")
        chosen = materialise(_may_be(rows, met).join(met, "key"), "candidates")
        parts += [_matches(chosen.filter(F.array_contains("kinds", r.kind)), r) for r in indexed]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    before = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.distinct().withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    rank, least = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, r in enumerate(rules):
        rank, least = F.when(F.col("kind") == r.kind, i).otherwise(rank), F.when(F.col("kind") == r.kind, r.least).otherwise(least)
    kept = found.filter(F.col("part") >= least).select("key", F.struct((F.col("end") - F.col("size")).alias("start"), rank.alias("rank"), F.col("end").alias("end"), "kind").alias("span"))
    return kept.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, index: TrigramIndex | None = None) -> DataFrame:
    """One row per row of docs: id and spans, an array that is empty where there are none."""
    found = materialise(scan(docs, id_col, text_col, rules, index), "spans")
    own = docs.select(F.col(id_col).alias("id"), _key(id_col, F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    none = F.array().cast(dict(found.dtypes)["spans"])
    return own.join(found, "key", "left").select("id", F.coalesce("spans", none).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(write(base), 256).alias("base_sha256"),
        write(F.col("spans")).alias("spans"),
    )


def _either_case(pattern: str) -> str:
    """The assign rule's keys with both cases of ASCII letters spelled out, as folding in RE2 goes beyond ASCII."""
    keys, value = pattern.split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in keys) + ")" + value


def _twin_of(rank: int, kind: str, pattern: str, group: int, least: int, lead: str = "0") -> str:
    """Spans of one rule from its matches and the gaps before them. lead: characters of a match before the span."""
    quoted = pattern.replace("'", "''")
    lists = f"regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', {group}) AS p, regexp_extract_all(t, '{quoted}', 1) AS l"
    before = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    each = f"SELECT doc_id, m, g, p, l, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {lists} FROM d WHERE regexp_matches(t, '{quoted}'))"
    return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST({before} + {lead} AS BIGINT) AS a, CAST({before} + length(m[i]) AS BIGINT) AS b FROM ({each}) WHERE length(p[i]) >= {least}"


_TWINS = (
    _twin_of(0, "assign", _either_case(BASE_RULES[0].pattern), 2, 6),
    _twin_of(1, "access", "(" + BASE_RULES[1].pattern + ")", 0, 20),
    _twin_of(2, "hex", "(" + BASE_RULES[2].pattern + ")", 0, 24),
    _twin_of(3, "private_key", "(" + EXTRA_RULES[0].pattern + ")", 0, 1),
    _twin_of(4, "github", "(" + EXTRA_RULES[1].pattern + ")", 0, 1),
    # RE2 looks behind nothing: what stands before the token is matched too and left out of the span
    _twin_of(5, "jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, "length(l[i])"),
)
_SPANS = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_TWINS) + ") "
    "SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
    f"sha256(coalesce({_SPANS} FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256, coalesce({_SPANS}, '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"
)
