"""VectorSQL statements as Spark SQL.

Spark parses and plans the result; this module only replaces what Spark has no syntax
for, token by token: embedding calls, MATCH with its k, infix distances, scalar WITH items and,
in the SQLite dialect, functions of other meaning. A MATCH search becomes a derived table that is cut to k
before any join, with the predicates on its own table inside; in the other dialects
ORDER BY distance LIMIT n keeps its plain meaning.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import compat

TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\d+\.?\d*(?:[eE][+-]?\d+)?|<->|<#>|<=>|<>|!=|<=|>=|\|\||::|:?\w+|\S", re.S)
CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "WINDOW")
SET_OPS = ("UNION", "INTERSECT", "EXCEPT")
#: Functions whose SQLite meaning differs from Spark's function of that name, or that Spark lacks.
DIFFERENT = {
    "ABS", "CHANGES", "TOTAL_CHANGES", "CHAR", "CONCAT", "FORMAT", "GLOB", "HEX", "IIF", "LAST_INSERT_ROWID", "LIKELIHOOD", "LIKELY", "UNLIKELY", "LOAD_EXTENSION", "LTRIM", "RTRIM",
    "TRIM", "MAX", "MIN", "QUOTE", "RANDOM", "RANDOMBLOB", "ROUND", "SIGN", "SOUNDEX", "SQLITE_COMPILEOPTION_GET", "SQLITE_COMPILEOPTION_USED", "SQLITE_OFFSET", "SQLITE_SOURCE_ID",
    "SQLITE_VERSION", "SUBSTR", "SUBSTRING", "TYPEOF", "UNHEX", "UNICODE", "ZEROBLOB", "GROUP_CONCAT", "STRING_AGG", "TOTAL", "ACOS", "ACOSH", "ASIN", "ATANH", "SQRT", "LOG", "MOD", "TRUNC",
    "DATE", "TIME", "DATETIME", "JULIANDAY", "UNIXEPOCH", "STRFTIME", "TIMEDIFF",
}

#: SQLite's storage classes as Spark's types of the same width.
CAST_TYPES = {"TEXT": "STRING", "INTEGER": "BIGINT", "INT": "BIGINT", "REAL": "DOUBLE", "BLOB": "BINARY"}


class VectorSqlError(ValueError):
    """A statement that can't be rewritten."""


@dataclass
class Search:
    """One MATCH: its block (a CTE's name or main), table, alias, vector column, size and own predicates."""

    block: int
    table: str
    alias: str
    column: str
    k: int
    filters: list[str] = field(default_factory=list)


@dataclass
class Statement:
    sql: str
    embeddings: list[tuple[str, str]]  # (model, text) of parameter v0, v1, ...
    vectors: dict[str, list[float]]  # vectors given as literals, by parameter
    searches: list[Search]


def tokens(sql: str) -> list[str]:
    return [t for t in TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def unquote(token: str) -> str:
    if token[:1] in "'\"" and len(token) > 1:
        return token[1:-1].replace(token[0] * 2, token[0])
    return token.strip("`")


def literal(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _leaf(token: str) -> str:
    """A token as Spark writes it: string literals escaped, double-quoted names in backquotes."""
    return literal(unquote(token)) if token.startswith("'") else "`" + unquote(token) + "`" if token.startswith('"') else token


def joined(t: list[str]) -> str:
    """Tokens with a space in between, but none around dots. What stands in a token stays as it is."""
    out = ""
    for i, x in enumerate(t):
        out += x if not i or x == "." or t[i - 1] == "." else " " + x
    return out


def _close(t: list[str], at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(t)):
        depth += (t[i] == "(") - (t[i] == ")")
        if depth == 0:
            return i
    raise VectorSqlError("unbalanced parentheses")


def _split(t: list[str], by: str) -> list[list[str]]:
    """Parts between the tokens ``by`` outside parentheses; the AND of a BETWEEN and those inside CASE don't count."""
    out, depth, pending, case = [[]], 0, 0, 0
    for x in t:
        up = x.upper()
        depth += (x == "(") - (x == ")")
        if depth == 0:
            case += (up == "CASE") - (up == "END" and case > 0)
            pending += up == "BETWEEN"
            if up == by and not case:
                if by == "AND" and pending:
                    pending -= 1
                else:
                    out.append([])
                    continue
        out[-1].append(x)
    return out


def _operand(t: list[str], at: int, step: int) -> int:
    """The far end of the primary expression that starts (or, with step -1, ends) at ``at``."""
    if step > 0:
        i = at
        while i + 2 < len(t) and t[i + 1] == ".":
            i += 2
        return _close(t, i + 1) if i + 1 < len(t) and t[i + 1] == "(" else _close(t, i) if t[i] == "(" else i
    i = at
    if t[i] == ")":
        depth = 0
        while True:
            depth += (t[i] == ")") - (t[i] == "(")
            if depth == 0:
                break
            i -= 1
        if i and re.fullmatch(r"\w+", t[i - 1]) and t[i - 1].upper() not in ("SELECT", "BY", "WHERE", "AND", "OR", "ON"):
            i -= 1
    while i >= 2 and t[i - 1] == ".":
        i -= 2
    return i


class _Rewriter:
    def __init__(self, columns_of: Callable[[str], list[str]] | None):
        self.columns_of = columns_of or (lambda table: [])
        self.embeddings: list[tuple[str, str]] = []
        self.vectors: dict[str, list[float]] = {}
        self.searches: list[Search] = []

    def parameter(self, model: str, text: str) -> str:
        """One parameter for each distinct (model, text)."""
        if (model, text) not in self.embeddings:
            self.embeddings.append((model, text))
        return f":v{self.embeddings.index((model, text))}"

    def embed_calls(self, t: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(t):
            if t[i].lower() == "lembed" and i + 1 < len(t) and t[i + 1] == "(":
                end = _close(t, i + 1)
                args = _split(t[i + 2 : end], ",")
                if len(args) != 2 or not args[1] or args[1][0][0] not in "'\"":
                    raise VectorSqlError("lembed takes a model and a literal text")
                out.append(self.parameter(unquote("".join(args[0])), unquote(args[1][0])))
                i = end + 1
                continue
            out.append(t[i])
            i += 1
        return out

    def scalar_with(self, t: list[str]) -> list[str]:
        """WITH :v0 AS name, ... : the items go, their names become the parameters."""
        if not t or t[0].upper() != "WITH":
            return t
        names, i = {}, 1
        while i + 2 < len(t) and t[i].startswith(":v") and t[i + 1].upper() == "AS":
            names[t[i + 2]] = t[i]
            i += 3
            if i < len(t) and t[i] == ",":
                i += 1
        if not names:
            return t
        rest = t[i:]
        return [names.get(x, x) for x in (rest if rest and rest[0].upper() == "SELECT" else ["WITH", *rest])]

    def infix(self, t: list[str]) -> list[str]:
        for op, name in (("<->", "l2_distance"), ("<#>", "neg_inner_product")):
            while op in t:
                at = t.index(op)
                a, b = _operand(t, at - 1, -1), _operand(t, at + 1, 1)
                t = [*t[:a], name, "(", *t[a:at], ",", *t[at + 1 : b + 1], ")", *t[b + 1 :]]
        return t

    def matches(self, t: list[str]) -> list[str]:
        """Every MATCH of the block and of the blocks inside it."""
        out, i = [], 0
        while i < len(t):  # inner blocks first
            if t[i] == "(":
                end = _close(t, i)
                out += ["(", *self.matches(t[i + 1 : end]), ")"]
                i = end + 1
            else:
                out.append(t[i])
                i += 1
        cuts, depth = [0], 0
        for i, x in enumerate(out):
            depth += (x == "(") - (x == ")")
            if depth == 0 and x.upper() in SET_OPS:
                cuts.append(i)
        parts = [out[a:b] for a, b in zip(cuts, [*cuts[1:], len(out)])]
        return [x for p in parts for x in self.block(p)]

    def block(self, t: list[str]) -> list[str]:
        depth, at = 0, {}
        for i, x in enumerate(t):
            depth += (x == "(") - (x == ")")
            if depth == 0 and x.upper() in CLAUSES and x.upper() not in at:
                at[x.upper()] = i
        if "WHERE" not in at or not any(x.upper() == "MATCH" for x in t[at["WHERE"] :]):
            return t
        stop = lambda c: min([i for k, i in at.items() if i > at[c]], default=len(t))
        conditions = _split(t[at["WHERE"] + 1 : stop("WHERE")], "AND")
        is_match = lambda c: any(x.upper() == "MATCH" for x in _flat(c))
        if any(is_match(c) and any(x.upper() == "OR" for x in _flat(c)) for c in conditions):
            raise VectorSqlError("MATCH can't stand under OR")
        searches = [c for c in conditions if is_match(c)]
        if not searches:
            return t
        source = t[at["FROM"] + 1 : stop("FROM")]
        tables = _tables(source)
        rest = [c for c in conditions if c not in searches]
        bounds, plain = [], []
        for c in rest:
            (bounds if len(c) in (3, 5) and c[-2] == "=" and c[-3].lower() == "k" and c[-1].isdigit() else plain).append(c)
        for c in searches:
            alias = self._owner(c[: _flat_index(c, "MATCH")], tables)
            own_bound = [b for b in bounds if (len(b) == 5 and b[0].lower() == alias.lower()) or (len(b) == 3 and (len(searches) == 1 or len(tables) == 1))]
            if own_bound:
                k = int(own_bound[0][-1])
            elif len(searches) == 1 and "LIMIT" in at and (cut := _cut(t[at["LIMIT"] :])):
                k = sum(cut)  # joins and DISTINCT come after the search, so the statement's own LIMIT stays
            else:
                raise VectorSqlError("MATCH needs a bound: k = n, or LIMIT n with a single search")
            i = _flat_index(c, "MATCH")
            column, query = c[i - 1], c[i + 1]
            if not query.startswith(":v"):
                name = f"m{len(self.vectors)}"
                self.vectors[name] = json.loads(unquote(query))
                query = f":{name}"
            mine = [p for p in plain if self._belongs(p, alias, tables)]
            plain = [p for p in plain if p not in mine]
            table = next(n for n, a, *_ in tables if a == alias)
            key = (self.columns_of(unquote(table)) or [""])[0]
            derived = ["(", "SELECT", "*", ",", "l2_distance", "(", column, ",", query, ")", "AS", "distance", "FROM", table, "AS", alias]
            derived += ["WHERE", column, "IS", "NOT", "NULL", *[x for p in mine for x in ("AND", "(", *p, ")")]]
            derived += ["ORDER", "BY", "distance", *([",", f"`{key}`"] if key else []), "LIMIT", str(k), ")", "AS", alias]
            self.searches.append(Search(len(self.searches), unquote(table), alias, column, k, [" ".join(p) for p in mine]))
            _, _, a, b = next(x for x in tables if x[1] == alias)
            source = [*source[:a], *derived, *source[b:]]
            tables = _tables(source)
        where = [x for i, p in enumerate(plain) for x in (["AND"] if i else []) + p]
        tail = t[stop("WHERE") :]
        if "LIMIT" in at and t[at["LIMIT"] + 2 : at["LIMIT"] + 3] == [","] and (cut := _cut(t[at["LIMIT"] :])):
            at_limit = len(tail) - (len(t) - at["LIMIT"])
            tail = [*tail[:at_limit], "LIMIT", str(cut[0]), "OFFSET", str(cut[1]), *tail[at_limit + 4 :]]
        return [*t[: at["FROM"] + 1], *source, *(["WHERE", *where] if where else []), *tail]

    def _owner(self, chain: list[str], tables) -> str:
        """The alias that a vector column belongs to."""
        if len(chain) >= 3 and chain[-2] == ".":
            for _, alias, *_ in tables:
                if unquote(alias).lower() == unquote(chain[-3]).lower():
                    return alias
            raise VectorSqlError(f"no table {chain[-3]}")
        if len(tables) == 1:
            return tables[0][1]
        having = [a for n, a, *_ in tables if unquote(chain[-1]).lower() in map(str.lower, self.columns_of(unquote(n)))]
        if len(having) != 1:
            raise VectorSqlError(f"column {chain[-1]} is ambiguous")
        return having[0]

    def _belongs(self, condition: list[str], alias: str, tables) -> bool:
        """Whether a predicate mentions no other table than alias."""
        if any(x.upper() == "SELECT" for x in condition):
            return False
        named = {condition[i - 1].lower() for i, x in enumerate(condition) if x == "." and i}
        if named - {alias.lower()}:
            return False
        if len(tables) == 1:
            return True
        plain = {unquote(x).lower() for i, x in enumerate(condition) if re.fullmatch(r"[A-Za-z_]\w*|\".*\"|`.*`", x) and (i == 0 or condition[i - 1] != ".") and (i + 1 == len(condition) or condition[i + 1] not in (".", "("))}
        mine = {c.lower() for n, a, *_ in tables if a == alias for c in self.columns_of(unquote(n))}
        theirs = {c.lower() for n, a, *_ in tables if a != alias for c in self.columns_of(unquote(n))}
        return not plain & theirs and bool(named or plain & mine)

    def functions(self, t: list[str]) -> list[str]:
        """SQLite's functions and its case-insensitive LIKE; other tokens as Spark writes them."""
        out, i = [], 0
        while i < len(t):
            up = t[i].upper()
            if up in DIFFERENT and i + 1 < len(t) and t[i + 1] == "(":
                end = _close(t, i + 1)
                inner = t[i + 2 : end]
                if not (inner and inner[0].upper() == "DISTINCT") and inner != ["*"]:
                    args = [joined(self.functions(a)) for a in _split(inner, ",")] if inner else []
                    out.append(compat.translate(up, args))
                    i = end + 1
                    continue
            elif up == "CAST" and i + 1 < len(t) and t[i + 1] == "(":
                end = _close(t, i + 1)
                inner = self.functions(t[i + 2 : end])
                inner[-1] = CAST_TYPES.get(inner[-1].upper(), inner[-1])
                out += [t[i], "(", *inner, ")"]
                i = end + 1
                continue
            elif up == "GLOB" and i + 1 < len(t) and t[i + 1].startswith("'"):
                out += ["RLIKE", literal(compat.glob_to_regex(unquote(t[i + 1])))]
                i += 2
                continue
            out.append("ILIKE" if up == "LIKE" else _leaf(t[i]))
            i += 1
        return out


def _cut(t: list[str]) -> tuple[int, int] | None:
    """(rows, rows skipped) of LIMIT n, LIMIT n OFFSET m and LIMIT m, n; None if n isn't a number."""
    if not t[1:2] or not t[1].isdigit():
        return None
    if t[2:3] == [","] and t[3:4] and t[3].isdigit():
        return int(t[3]), int(t[1])
    if [x.upper() for x in t[2:3]] == ["OFFSET"] and t[3:4] and t[3].isdigit():
        return int(t[1]), int(t[3])
    return int(t[1]), 0


def _flat(t: list[str]) -> list[str]:
    out, depth = [], 0
    for x in t:
        depth += (x == "(") - (x == ")")
        if depth == 0:
            out.append(x)
    return out


def _flat_index(t: list[str], word: str) -> int:
    depth = 0
    for i, x in enumerate(t):
        depth += (x == "(") - (x == ")")
        if depth == 0 and x.upper() == word:
            return i
    raise VectorSqlError(f"no {word}")


def _tables(t: list[str]) -> list[tuple[str, str, int, int]]:
    """(table, alias, first, end) of the named tables of a FROM clause."""
    out, depth, due = [], 0, True
    i = 0
    while i < len(t):
        x = t[i]
        if x == "(":
            i, due = _close(t, i) + 1, False
            continue
        if x == "," or x.upper() == "JOIN":
            due = True
        elif due and re.fullmatch(r"\w+|\".*\"|`.*`", x) and x.upper() not in ("LATERAL",):
            first = i
            while i + 2 < len(t) and t[i + 1] == ".":
                i += 2
            name, alias = "".join(t[first : i + 1]), t[i]
            if i + 1 < len(t) and t[i + 1].upper() == "AS":
                i += 2
                alias = t[i]
            elif i + 1 < len(t) and re.fullmatch(r"[A-Za-z_]\w*|\".*\"|`.*`", t[i + 1]) and t[i + 1].upper() not in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "USING", "NATURAL"):
                i += 1
                alias = t[i]
            out.append((name, alias, first, i + 1))
            due = False
        i += 1
    return out


def rewrite(sql: str, dialect: str = "sqlite", columns_of: Callable[[str], list[str]] | None = None) -> Statement:
    """dialect: sqlite, postgresql, clickhouse or myscale. columns_of gives a table's column names, first its key."""
    if dialect not in ("sqlite", "postgresql", "clickhouse", "myscale"):
        raise VectorSqlError(f"unknown dialect {dialect}")
    if "<=>" in (t := tokens(sql)):
        raise VectorSqlError("<=> is null-safe equality in Spark; call cosine_distance")
    if t and t[-1] == ";":
        t = t[:-1]
    r = _Rewriter(columns_of)
    t = r.matches(r.infix(r.scalar_with(r.embed_calls(t))))
    t = r.functions(t) if dialect == "sqlite" else [_leaf(x) for x in t]
    return Statement(joined(t), r.embeddings, r.vectors, r.searches)
