"""How a VectorSQL statement combines vector search with relational operators.

Levels: 0 no search, 1 pure, 2 pre-filtered, 3 post-filtered, 4 aggregated, 5 joined,
6 within a subquery, 7 several independent searches, 8 interdependent ones, 9 hybrids.
A block that searches has a WHERE of its own, so if it also consumes an earlier search it counts as
filtered after that, and as several searches: such statements are hybrids, and level 8 is left to forms without a WHERE.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectorsql import _close, _flat, _split, tokens

SEARCH = re.compile(r"\bMATCH\s*(?:lembed\s*\(|'\s*\[)", re.I)


def blocks(sql: str) -> dict[str, list[str]]:
    """Tokens of each common table expression by name, and of the main query."""
    t, out, i = tokens(sql), {}, 0
    if t and t[0].upper() == "WITH":
        i = 1 + (t[1].upper() == "RECURSIVE")
        while i < len(t):
            name, i = t[i], i + 1
            if t[i] == "(":
                i = _close(t, i) + 1
            if t[i].upper() != "AS":
                break
            end = _close(t, i + 1)
            out[name.lower()] = t[i + 2 : end]
            i = end + 1
            if i >= len(t) or t[i] != ",":
                break
            i += 1
    out["main"] = t[i:]
    return out


class _Block:
    """One query block of a statement: what it searches, reads, asks for and folds."""

    ENDS = frozenset(("WHERE", "GROUP", "ORDER", "LIMIT"))

    def __init__(self, body: list[str]):
        self.words = [x.upper() for x in body]
        self.searches = self.words.count("MATCH")
        self.reads = {b.lower() for a, b in zip(self.words, self.words[1:]) if a in ("FROM", "JOIN")}
        self.joins = "JOIN" in _flat(self._after("FROM"))
        asked = [c for c in _split(self._after("WHERE"), "AND") if c]
        self.filtered = bool(asked)
        #: Predicates that are neither the search itself nor its size, k = n or t.k = n.
        self.others = [c for c in asked if "MATCH" not in c and not (len(c) in (3, 5) and c[-3] == "K")]

    def _after(self, word: str) -> list[str]:
        at = self.words.index(word) + 1 if word in self.words else len(self.words)
        return list(itertools.takewhile(lambda w: w not in self.ENDS, self.words[at:]))

    @staticmethod
    def tables(predicate: list[str]) -> set[str]:
        return {a for a, dot in zip(predicate, predicate[1:]) if dot == "."}

    def folds(self) -> bool:
        return not {"GROUP", "HAVING"}.isdisjoint(self.words) or any(a in ("COUNT", "SUM", "AVG", "MAX", "MIN") and b == "(" for a, b in zip(self.words, self.words[1:]))

    def searches_inside(self) -> bool:
        """Whether a search stands in a subquery of IN or EXISTS."""
        opened = [i + 1 for i, w in enumerate(self.words[:-2]) if w in ("IN", "EXISTS") and self.words[i + 1 : i + 3] == ["(", "SELECT"]]
        return any("MATCH" in self.words[i : _close(self.words, i)] for i in opened)


#: The level that a trait stands for; the highest one decides.
LEVELS = {"filtered before": 2, "filtered after": 3, "aggregated": 4, "joined": 5, "nested": 6, "several": 7, "dependent": 8}
HYBRID = 9


def traits(sql: str) -> set[str] | None:
    """How the searches of a statement are combined with its other parts; None where it has none."""
    tree = {name: _Block(body) for name, body in blocks(sql).items()}
    searching = {name for name, b in tree.items() if b.searches}
    if not searching:
        return None
    found = {"several"} if sum(b.searches for b in tree.values()) > 1 else set()
    results = searching - {"main"}
    for name, b in tree.items():
        own = name in searching
        consumes = name not in results and bool(b.reads & results)
        found |= {"several"} if "UNION" in b.words else set()
        found |= {"nested"} if b.searches_inside() else set()
        found |= {"aggregated"} if b.folds() and (own or b.reads & searching) else set()
        found |= {"dependent"} if consumes and own else set()
        found |= {"filtered after"} if consumes and b.filtered else set()
        if own:
            across = [len(b.tables(c)) > 1 for c in b.others]
            found |= {"joined"} if b.joins or any(across) else set()
            found |= {"filtered before"} if any(not x and "SELECT" not in c for x, c in zip(across, b.others)) else set()
    return found


def integration_level(sql: str) -> int:
    found = traits(sql)
    if found is None:
        return 0
    coupled = found & {"joined", "aggregated", "nested", "filtered after"}
    if coupled and len(coupled) + ("several" in found) > 1:
        return HYBRID
    return max((LEVELS[t] for t in found), default=1)


@F.pandas_udf(T.IntegerType())
def _levels(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: None if s is None else integration_level(s)).astype("Int32")


def with_level(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Adds integration_level to a table of statements."""
    return df.withColumn("integration_level", _levels(F.col(sql_col)))


def is_vector_query(sql: Column) -> Column:
    return sql.rlike(r"(?i)\bMATCH\s*(lembed\s*\(|'\s*\[)")


def complexity(sql: Column) -> Column:
    """Simple, Moderate, Complex or Highly Complex."""
    has = lambda pattern: sql.rlike("(?is)" + pattern)
    ctes = F.regexp_count(sql, F.lit(r"(?i)\bAS\s*\(\s*SELECT\b"))
    return (
        F.when(has(r"\bRECURSIVE\b") | has(r"\bUNION\b") | (has(r"^\s*WITH\b") & (ctes > 1)), "Highly Complex")
        .when(has(r"^\s*WITH\b") | has(r"\bOVER\s*\(") | (F.regexp_count(sql, F.lit(r"(?i)\bSELECT\b")) > 2) | (F.regexp_count(sql, F.lit(r"(?i)\bJOIN\b")) > 1), "Complex")
        .when(has(r"\bJOIN\b|\bGROUP\s+BY\b|\bHAVING\b|\bIN\s*\(|\bBETWEEN\b|\bLIKE\b|\(\s*SELECT\b"), "Moderate")
        .otherwise("Simple")
    )
