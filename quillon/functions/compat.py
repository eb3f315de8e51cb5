"""SQLite's scalar, aggregate, window, mathematical and date functions in Spark SQL.

Each entry gives the Spark SQL text for a call with the given argument texts. Names
that Spark evaluates alike map to themselves. ``translate(name, args)`` is what the
VectorSQL front end calls; ``expr(name, *args)`` gives a Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Unsupported(ValueError):
    """A function that reads a connection's or the engine's internals, or loads code."""


def _any_null(args: list[str], body: str) -> str:
    return f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in args)} THEN NULL ELSE {body} END"


def _real(name: str) -> Callable[..., str]:
    """NaN, where Spark has it for arguments outside the domain, is NULL in SQLite."""
    return lambda x: f"nanvl({name}(CAST({x} AS DOUBLE)), NULL)"


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _literal(text: str) -> str | None:
    m = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", text)
    return m[1].replace("''", "'") if m else None


def _glob(pattern: str, value: str) -> str:
    known = _literal(pattern)
    if known is None:
        raise Unsupported("GLOB needs a literal pattern")
    return f"({value} RLIKE '{_escaped(glob_to_regex(known))}')"


def _escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


_UNITS = {"year": "YEAR", "month": "MONTH", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND"}


def _moment(args: list[str]) -> str:
    """A timestamp: the first argument with the modifiers applied in turn."""
    first = args[0] if args else "'now'"
    out = "current_timestamp()" if (_literal(first) or "").lower() == "now" else f"try_cast({first} AS TIMESTAMP)"
    for mod in args[1:]:
        text = (_literal(mod) or "").strip().lower()
        if m := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(year|month|day|hour|minute|second)s?", text):
            out = f"({out} + INTERVAL '{m[1]}' {_UNITS[m[2]]})"
        elif m := re.fullmatch(r"start of (year|month|day)", text):
            out = f"date_trunc('{m[1]}', {out})"
        elif text == "unixepoch":
            out = f"timestamp_seconds(CAST({first} AS DOUBLE))"
        elif text in ("utc", "localtime"):
            pass  # the session's time zone is UTC
        else:
            raise Unsupported(f"date modifier {mod}")
    return out


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}


def _strftime(form: str, *args: str) -> str:
    known = _literal(form)
    if known is None:
        raise Unsupported("STRFTIME needs a literal format")
    at, parts = _moment(list(args)), []
    for piece in re.findall(r"%.|[^%]+", known):
        if piece in ("%s",):
            parts.append(f"CAST(unix_timestamp({at}) AS STRING)")
        elif piece == "%w":
            parts.append(f"CAST(dayofweek({at}) - 1 AS STRING)")
        elif piece == "%J":
            parts.append(f"CAST({TRANSLATIONS['JULIANDAY'](*args)} AS STRING)")
        elif piece == "%%":
            parts.append("'%'")
        elif piece[0] == "%":
            if piece[1] not in _STRFTIME:
                raise Unsupported(f"date format {piece}")
            parts.append(f"date_format({at}, '{_STRFTIME[piece[1]]}')")
        else:
            parts.append(f"'{_escaped(piece)}'")
    return f"concat({', '.join(parts)})"


def _timediff(a: str, b: str) -> str:
    x, y = f"try_cast({a} AS TIMESTAMP)", f"try_cast({b} AS TIMESTAMP)"
    lo, hi = f"least({x}, {y})", f"greatest({x}, {y})"
    months = f"timestampdiff(MONTH, {lo}, {hi})"
    rest = f"timestampdiff(MICROSECOND, {lo} + make_ym_interval(0, CAST({months} AS INT)), {hi})"
    return (f"concat(CASE WHEN {x} >= {y} THEN '+' ELSE '-' END, format_string('%04d-%02d-%02d %02d:%02d:%02d.%03d', {months} DIV 12, {months} % 12, {rest} DIV 86400000000, "
            f"({rest} DIV 3600000000) % 24, ({rest} DIV 60000000) % 60, ({rest} DIV 1000000) % 60, ({rest} DIV 1000) % 1000))")  # fmt: skip


def _refuse(*args: str) -> str:
    raise Unsupported("reads the connection or the engine, or loads code")


def _same(name: str) -> Callable[..., str]:
    return lambda *args: f"{name}({', '.join(args)})"


def _char(*codes: str) -> str:
    return "concat_ws('', " + ", ".join(f"decode(unhex(lpad(hex(CAST({c} AS BIGINT)), 8, '0')), 'UTF-32')" for c in codes) + ")"


def _max(pick: str):
    return lambda *args: f"max({args[0]})" if len(args) == 1 and pick == "greatest" else f"min({args[0]})" if len(args) == 1 else _any_null(list(args), f"{pick}({', '.join(args)})")


def _unhex(x: str, skip: str = "''") -> str:
    clean = f"translate({x}, {skip}, '')" if skip != "''" else x
    return f"CASE WHEN length({clean}) % 2 = 0 THEN unhex({clean}) END"


TRANSLATIONS: dict[str, Callable[..., str]] = {
    # scalar
    "ABS": lambda x: f"abs(coalesce(try_cast({x} AS DOUBLE), CASE WHEN {x} IS NOT NULL THEN 0D END))",
    "CHANGES": lambda: "CAST(0 AS BIGINT)",
    "TOTAL_CHANGES": lambda: "CAST(0 AS BIGINT)",
    "CHAR": _char,
    "COALESCE": _same("coalesce"),
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(a)})",
    "CONCAT_WS": _same("concat_ws"),
    "FORMAT": _same("format_string"),
    "PRINTF": _same("format_string"),
    "GLOB": _glob,
    "HEX": lambda x: f"hex(CAST({x} AS STRING))",
    "IFNULL": _same("ifnull"),
    "IIF": lambda x, y, z="NULL": f"if({x}, {y}, {z})",
    "INSTR": _same("instr"),
    "LAST_INSERT_ROWID": _refuse,
    "LENGTH": _same("length"),
    "LIKE": lambda x, y, z=None: f"({y} ILIKE {x}" + (f" ESCAPE {z})" if z else ")"),
    "LIKELIHOOD": lambda x, p=None: f"({x})",
    "LIKELY": lambda x: f"({x})",
    "UNLIKELY": lambda x: f"({x})",
    "LOAD_EXTENSION": _refuse,
    "LOWER": _same("lower"),
    "UPPER": _same("upper"),
    "LTRIM": lambda x, y="' '": f"ltrim({y}, {x})",
    "RTRIM": lambda x, y="' '": f"rtrim({y}, {x})",
    "TRIM": lambda x, y="' '": f"trim(BOTH {y} FROM {x})",
    "MAX": _max("greatest"),
    "MIN": _max("least"),
    "NULLIF": _same("nullif"),
    "OCTET_LENGTH": _same("octet_length"),
    "QUOTE": lambda x: f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) = 'string' THEN concat('\\'', replace({x}, '\\'', '\\'\\''), '\\'') ELSE CAST({x} AS STRING) END",
    "RANDOM": lambda: "CAST((rand() - 0.5) * 18446744073709551615D AS BIGINT)",
    "RANDOMBLOB": lambda n: f"unhex(substring(repeat(replace(uuid(), '-', ''), CAST(ceil({n} / 16D) AS INT)), 1, 2 * {n}))",
    "REPLACE": _same("replace"),
    "ROUND": lambda x, y="0": f"round(CAST({x} AS DOUBLE), {y if re.fullmatch(r'[0-9]+', y.strip()) else '0' if y.strip().startswith('-') else y})",
    "SIGN": lambda x: f"CAST(sign(try_cast({x} AS DOUBLE)) AS INT)",
    "SOUNDEX": lambda x: f"CASE WHEN {x} IS NULL OR NOT {x} RLIKE '[A-Za-z]' THEN '?000' ELSE soundex({x}) END",
    "SQLITE_COMPILEOPTION_GET": _refuse,
    "SQLITE_COMPILEOPTION_USED": _refuse,
    "SQLITE_OFFSET": _refuse,
    "SQLITE_SOURCE_ID": _refuse,
    "SQLITE_VERSION": lambda: "version()",
    # a start of 0 lies before the first character, and takes one of the length
    "SUBSTR": lambda x, y, z=None: f"substring({x}, {y})" if z is None else f"CASE WHEN {y} = 0 THEN substring({x}, 1, greatest({z} - 1, 0)) WHEN {z} < 0 THEN substring({x}, greatest({y} + {z}, 1), least(-({z}), {y} - 1)) ELSE substring({x}, {y}, {z}) END",
    "TYPEOF": lambda x: f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END",
    "UNHEX": _unhex,
    "UNICODE": _same("ascii"),
    "ZEROBLOB": lambda n: f"unhex(repeat('00', {n}))",
    # aggregates
    "AVG": lambda x: f"avg(CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast({x} AS DOUBLE), 0D) END)",
    "COUNT": _same("count"),
    "GROUP_CONCAT": lambda x, sep="','": f"listagg(CAST({x} AS STRING), {sep}) WITHIN GROUP (ORDER BY {x})",
    "SUM": _same("sum"),
    "TOTAL": lambda x: f"coalesce(sum(CAST({x} AS DOUBLE)), 0D)",
    # windows: OVER follows the call
    **{n: _same(n.lower()) for n in ("ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE")},
    # mathematics
    **{n: _real(n.lower()) for n in ("ACOS", "ACOSH", "ASIN", "ASINH", "ATAN", "ATANH", "COS", "COSH", "EXP", "SIN", "SINH", "SQRT", "TAN", "TANH")},
    **{n: _same(n.lower()) for n in ("ATAN2", "CEIL", "DEGREES", "FLOOR", "LN", "LOG2", "PI", "RADIANS")},
    "CEILING": _same("ceil"),
    "LOG": lambda x, y=None: f"log10({x})" if y is None else f"log({x}, {y})",
    "LOG10": _same("log10"),
    "MOD": _same("try_mod"),
    "POW": _same("power"),
    "POWER": _same("power"),
    "TRUNC": lambda x: f"if({x} < 0, ceil({x}), floor({x}))",
    # dates: texts, as in SQLite
    "DATE": lambda *a: f"date_format({_moment(list(a))}, 'yyyy-MM-dd')",
    "TIME": lambda *a: f"date_format({_moment(list(a))}, 'HH:mm:ss')",
    "DATETIME": lambda *a: f"date_format({_moment(list(a))}, 'yyyy-MM-dd HH:mm:ss')",
    "JULIANDAY": lambda *a: f"(unix_micros({_moment(list(a))}) / 86400000000D + 2440587.5D)",
    "UNIXEPOCH": lambda *a: f"unix_timestamp({_moment(list(a))})",
    "STRFTIME": _strftime,
    "TIMEDIFF": _timediff,
}
TRANSLATIONS |= {"SUBSTRING": TRANSLATIONS["SUBSTR"], "STRING_AGG": TRANSLATIONS["GROUP_CONCAT"]}


def translate(name: str, args: list[str]) -> str:
    """Spark SQL text of a call of the SQLite function name."""
    found = TRANSLATIONS.get(name.upper())
    return f"{name}({', '.join(args)})" if found is None else found(*args)


def expr(name: str, *args: str) -> Column:
    return F.expr(translate(name, list(args)))
