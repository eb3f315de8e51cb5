"""Declared schemas: DDL texts to Spark types, validation of described databases, keys for synthetic rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import numbered

#: The first pattern found in a declared type decides. DATETIME stands before DATE.
TYPE_RULES = (
    (r"FLOAT\s*\[|VECTOR\s*\(", T.ArrayType(T.FloatType(), False)),
    (r"BOOL", T.BooleanType()),
    (r"INT", T.LongType()),
    (r"CHAR|TEXT|CLOB", T.StringType()),
    (r"BLOB", T.BinaryType()),
    (r"REAL|FLOA|DOUB", T.DoubleType()),
    (r"NUMERIC|DECIMAL", T.DecimalType(38, 6)),
    (r"DATETIME|TIMESTAMP", T.TimestampType()),
    (r"DATE", T.DateType()),
)
#: Names that a search uses itself, and the prefix of names that begin with no letter.
RESERVED = {"distance": "distance_val", "k": "k_val"}
PREFIX = "fld_"
#: A day alone; with hours and minutes; with seconds too, after a space or a T, and with a fraction.
TIME_FORM = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}|[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?)?$"


def spark_type(declared: str) -> T.DataType:
    return next((t for pattern, t in TYPE_RULES if re.search(pattern, declared.upper())), T.StringType())


def column_name(name: str) -> str:
    clean = re.sub(r"\W", "_", name.strip("\"'`[]"))
    clean = PREFIX + clean if not re.match(r"[A-Za-z_]", clean) else clean
    return RESERVED.get(clean.lower(), clean)


def from_ddl(ddl: str) -> tuple[str, T.StructType]:
    """(table, schema) of a CREATE TABLE or CREATE VIRTUAL TABLE ... USING vec0 text; vectors keep their width as metadata."""
    m = re.search(r"CREATE\s+(?:VIRTUAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w\"`\[\].]+)\s*(?:USING\s+vec0\s*)?\((.*)\)", ddl, re.I | re.S)
    if not m:
        raise ValueError("not a CREATE TABLE text")
    fields = []
    for part in re.split(r",(?![^(\[]*[)\]])", re.sub(r"--[^\n]*", "", m[2])):
        words = part.split()
        if len(words) < 1 or words[0].upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"):
            continue
        declared = " ".join(words[1:]) or "TEXT"
        width = re.search(r"(?:float\s*\[|vector\s*\()\s*(\d+)", declared, re.I)
        fields.append(T.StructField(column_name(words[0]), spark_type(declared), "NOT NULL" not in declared.upper(), {"dim": int(width[1])} if width else {}))
    return m[1].strip("\"'`[]"), T.StructType(fields)


def keys_of_ddl(ddl: str) -> tuple[list[str], list[tuple[str, str, str]]]:
    """(primary key columns, foreign keys as (column, table, column)) of a CREATE TABLE text, declared with a column or apart."""
    body = re.sub(r"--[^\n]*", "", ddl[ddl.index("(") + 1 : ddl.rindex(")")])
    names = lambda text: [column_name(n.strip()) for n in text.split(",")]
    primary, foreign = [], []
    for part in re.split(r",(?![^(\[]*[)\]])", body):
        target = re.search(r"\bREFERENCES\s+([\w\"`\[\].]+)\s*(?:\(([^)]*)\))?", part, re.I)
        apart = re.match(r"\s*(?:CONSTRAINT\s+\S+\s+)?(PRIMARY|FOREIGN)\s+KEY\s*\(([^)]*)\)", part, re.I)
        own = names(apart[2]) if apart else names(part.split()[0]) if part.split() else []
        if re.search(r"\bPRIMARY\s+KEY\b", part, re.I):
            primary += own
        if target:
            theirs = names(target[2]) if target[2] else own
            foreign += [(c, target[1].strip("\"'`[]"), d) for c, d in zip(own, theirs)]
    return primary, foreign


def to_ddl(table: str, schema: T.StructType, dialect: str) -> str:
    """A CREATE TABLE text for PostgreSQL, ClickHouse or MyScale."""
    simple = {"bigint": ("BIGINT", "Int64"), "int": ("BIGINT", "Int64"), "string": ("TEXT", "String"), "binary": ("BYTEA", "String"), "double": ("DOUBLE PRECISION", "Float64"), "float": ("DOUBLE PRECISION", "Float64"), "boolean": ("BOOLEAN", "Bool"), "date": ("DATE", "Date"), "timestamp": ("TIMESTAMP", "DateTime64(6)"), "timestamp_ntz": ("TIMESTAMP", "DateTime64(6)")}
    columns, extra = [], []
    for f in schema.fields:
        kind, dim = f.dataType.simpleString(), f.metadata.get("dim")
        if kind.startswith("array"):
            columns.append(f'"{f.name}" vector' + (f"({dim})" if dim else "") if dialect == "postgresql" else f"`{f.name}` Array(Float32)")
            if dialect == "clickhouse" and dim:
                extra.append(f"INDEX idx_{f.name} `{f.name}` TYPE vector_similarity('hnsw', 'L2Distance', {dim}) GRANULARITY 1000")
            if dialect == "myscale" and dim:
                extra += [f"CONSTRAINT dim_{f.name} CHECK length(`{f.name}`) = {dim}", f"VECTOR INDEX idx_{f.name} `{f.name}` TYPE MSTG"]
            continue
        pg, ch = simple.get(kind, ("NUMERIC", "Decimal(38, 6)") if kind.startswith("decimal") else ("TEXT", "String"))
        columns.append(f'"{f.name}" {pg}' + ("" if f.nullable else " NOT NULL") if dialect == "postgresql" else f"`{f.name}` " + (f"Nullable({ch})" if f.nullable else ch))
    body = ",\n  ".join(columns + extra)
    return f'CREATE TABLE "{table}" (\n  {body}\n)' if dialect == "postgresql" else f"CREATE TABLE `{table}` (\n  {body}\n) ENGINE = MergeTree ORDER BY tuple()"


def coerce(df: DataFrame, schema: T.StructType, zero_nulls: bool = False) -> DataFrame:
    """df's columns cast to schema; what can't be cast is null, or the type's zero.

    Dates and timestamps are read in the forms of TIME_FORM, and no order of day and month is
    guessed; vectors are padded or cut to their width.
    """
    out = []
    for f in schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("date", "timestamp"):
            written = c.cast("string")
            c = F.when(written.rlike(TIME_FORM), written.try_cast("timestamp")).cast(kind)
        elif kind.startswith("array") and f.metadata.get("dim"):
            from ..functions.vector import resize

            c = resize(c, f.metadata["dim"])
        else:
            c = c.try_cast(f.dataType)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if zero_nulls and kind in ("bigint", "int", "double", "float", "string"):
            c = F.coalesce(c, F.lit("" if kind == "string" else 0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def valid_tables(described: DataFrame) -> DataFrame:
    """described: (db_id, table_name, columns, foreign_keys: array<struct<column, ref_table, ref_column>>).

    Drops tables without columns or with repeated ones, and foreign keys that lead nowhere.
    """
    rows = described.filter((F.size("columns") > 0) & (F.size(F.array_distinct("columns")) == F.size("columns")))
    have = rows.select(F.col("db_id").alias("d"), F.col("table_name").alias("t"), F.explode("columns").alias("c"))
    keys = rows.select("db_id", "table_name", F.explode("foreign_keys").alias("fk"))
    good = keys.join(have, (F.col("db_id") == F.col("d")) & (F.col("fk.ref_table") == F.col("t")) & (F.col("fk.ref_column") == F.col("c")), "left_semi")
    good = good.groupBy("db_id", "table_name").agg(F.array_sort(F.collect_set("fk")).alias("kept_keys"))
    return rows.join(good, ["db_id", "table_name"], "left").withColumn("foreign_keys", F.coalesce("kept_keys", F.filter("foreign_keys", lambda x: F.lit(False)))).drop("kept_keys")


#: The fields of a schema that is written as JSON.
SCHEMA_TEXT = (
    "tables array<struct<table_name: string, column_names: array<string>, column_types: array<string>, column_descriptions: array<string>>>, "
    "foreign_keys array<struct<source_table: string, column_in_source_table: string, referenced_table: string, column_in_referenced_table: string>>"
)
#: Characters that an id can't have, and its length before a suffix.
NOT_IN_IDS, ID_LENGTH = "()- *", 75


def parsed_schemas(df: DataFrame, text: str, domain: str, key: str) -> DataFrame:
    """(key, domain, db_id, tables, foreign_keys) of schemas written as JSON.

    Left out: texts that are null, can't be read or lack one of the two lists, and rows without a domain; tables without a name or whose names, types and
    descriptions aren't equally many; foreign keys that lack a part or name a table (in any case) that isn't among those kept.
    """
    rows = df.select(F.col(key).alias("key"), F.col(domain).alias("domain"), F.from_json(text, SCHEMA_TEXT).alias("s")).select("key", "domain", "s.*")
    rows = rows.filter("domain IS NOT NULL AND tables IS NOT NULL AND foreign_keys IS NOT NULL")
    size = lambda t, part: F.size(t[part])
    whole = lambda t: t["table_name"].isNotNull() & (size(t, "column_names") == size(t, "column_types")) & (size(t, "column_names") == size(t, "column_descriptions")) & t["column_names"].isNotNull()
    rows = rows.withColumn("tables", F.filter("tables", lambda t: F.coalesce(whole(t), F.lit(False))))
    names = F.transform("tables", lambda t: F.lower(t["table_name"]))
    leads = lambda k: F.array_contains(names, F.lower(k["source_table"])) & F.array_contains(names, F.lower(k["referenced_table"]))
    columns = lambda k: k["column_in_source_table"].isNotNull() & k["column_in_referenced_table"].isNotNull()
    rows = rows.withColumn("foreign_keys", F.filter("foreign_keys", lambda k: F.coalesce(leads(k) & columns(k), F.lit(False))))
    return database_ids(rows, "domain", "key").select("key", "domain", "db_id", "tables", "foreign_keys")


def database_ids(df: DataFrame, domain: str, key: str, name: str = "db_id") -> DataFrame:
    """Adds an id made of the domain's text. Equal ones are numbered by key from the second on, as id_2, id_3; where that is some row's own id, a digest follows it.

    key tells rows apart. A null domain has a null id. Numbers come from one order of the whole table, so a frequent domain is no large task.
    """
    lower = F.translate(F.lower(domain), NOT_IN_IDS, "_" * len(NOT_IN_IDS))
    base = F.left(F.regexp_replace(lower, r"^\s+|\s+$", ""), F.lit(ID_LENGTH))
    placed = numbered(df.withColumn("__base", base).withColumn("__key", F.struct("__base", F.col(key))), "__key", "__at").drop("__key")
    firsts = placed.groupBy(F.col("__base").alias("__b")).agg(F.min("__at").alias("__first")).filter("__b IS NOT NULL")
    out = placed.join(firsts, F.col("__base") == F.col("__b"), "left").withColumn("__n", F.col("__at") - F.col("__first") + 1).drop("__b")
    out = out.withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("_", "__base", "__n")).otherwise(F.col("__base")))
    taken = (F.col("__n") > 1) & (F.col(name) == F.col("__b"))
    out = out.join(firsts.select("__b"), taken, "left")
    digest = F.left(F.md5(F.concat_ws("/", "__base", "__n")), F.lit(12))
    return out.withColumn(name, F.when(F.col("__b").isNotNull(), F.concat_ws("_", name, digest)).otherwise(F.col(name))).drop("__base", "__at", "__first", "__n", "__b")


def assign_keys(df: DataFrame, order: str, primary: str, foreign: dict[str, int], seed: int = 42) -> DataFrame:
    """primary := the row's place by ``order``, from 0; foreign keys := numbers below the given table sizes, from the MD5 of seed, name and key."""
    out = numbered(df, order, primary, 0)
    for name, n in foreign.items():
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.col(primary).cast("string")))
        out = out.withColumn(name, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n)
    return out


def narrow(df: DataFrame, most: int = 16) -> DataFrame:
    """At most so many columns: vectors go first, then those at the end."""
    names = list(df.columns)
    for c in [c for c in reversed(names) if c.endswith("_embedding")]:
        if len(names) > most:
            names.remove(c)
    return df.select(*names[:most])
