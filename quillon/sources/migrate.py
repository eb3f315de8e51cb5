"""Copies of whole databases to folders and servers, with a report, and their schemas as texts."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, schemas

REPORT = "table string, target string, status string, rows long, seconds double, error string"


def _name(spark: SparkSession, target: str, table: str) -> str:
    """A table's name as the server of target quotes it: names may be words of its language."""
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(target).quoteIdentifier(table)


def digest(df: DataFrame) -> tuple[int, int, int]:
    """(rows, xor, sum) of the hashes of a table's rows: equal tables have equal ones in whatever order their rows come."""
    values = [F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values]) if values else F.lit("")
    one = F.xxhash64(nulls, *values)  # nulls leave a hash as it is, so which they are is hashed too
    n, x, s = df.select(one.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0))).first()
    return int(n), int(x), int(s)


def _at_target(spark: SparkSession, source: DataFrame, target: str, table: str, options: dict) -> DataFrame | None:
    """What a target holds of a table, in the types of source; None if it has no such table, or not a whole one."""
    if target.startswith("jdbc:"):
        try:
            found = catalog.jdbc(spark, target, _name(spark, target, table), **options)
            own = {c.lower(): c for c in found.columns}
            if set(own) != {c.lower() for c in source.columns}:
                return None
            pick = lambda c, t: F.from_json(F.col(f"`{own[c.lower()]}`"), t) if t.startswith("array") else F.col(f"`{own[c.lower()]}`").try_cast(t)
            return found.select(*[pick(c, t).alias(c) for c, t in source.dtypes])
        except Exception:  # noqa: BLE001  no such table; if the server is away, writing says so
            return None
    path = f"{target.rstrip('/')}/{table}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.parquet(path)
    return found if found.dtypes == source.dtypes else None


def _copy(spark: SparkSession, table: str, path: str, target: str, options: dict) -> tuple:
    """One table to one target, as a line of the report."""
    began = time.monotonic()
    try:
        source = spark.read.parquet(path)
        expected, status = digest(source), "present"
        held = _at_target(spark, source, target, table, options)
        found = None if held is None else digest(held)
        if found != expected:
            status = "written"
            if target.startswith("jdbc:"):
                catalog.write_jdbc(source, target, _name(spark, target, table), mode="overwrite", **options)
            else:
                source.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{table}.parquet")
            held = _at_target(spark, source, target, table, options)
            found = None if held is None else digest(held)
        if found != expected:
            raise ValueError(f"{found and found[0]} rows arrived of {expected[0]}" if not found or found[0] != expected[0] else "rows arrived changed")
        return table, target, status, found[0], time.monotonic() - began, None
    except Exception as e:  # noqa: BLE001  reported; the other tables are tried
        return table, target, "failed", None, time.monotonic() - began, str(e).splitlines()[0]


def migrate(spark: SparkSession, tables: dict[str, str], targets: list[str], threads: int = 4, **options) -> DataFrame:
    """Copies each table (name -> path) to each target, a JDBC URL or a folder. Report: (table, target, status, rows, seconds, error).

    Copies run side by side, and Spark's tasks move the rows. A table whose target holds the rows of its source, as ``digest`` tells, is
    "present" and left as it is, so a run that broke off is resumed by running it again, and a row that changed on either side is
    found. Anything else is written anew and compared: a folder shows a table only once it is whole, and a server's table that broke off is overwritten by the next run. An
    empty table is copied with its columns. A copy that fails stops no other.
    """
    jobs = [(name, path, target) for name, path in sorted(tables.items()) for target in targets]
    with ThreadPoolExecutor(threads) as pool:
        report = list(pool.map(lambda j: _copy(spark, *j, options), jobs))
    return spark.createDataFrame(report, REPORT)


def schema_texts(spark: SparkSession, frames: dict[str, DataFrame], dialect: str) -> DataFrame:
    """(table_name, ddl): the CREATE TABLE text of each frame, be it of a file, a view or a server's table."""
    return spark.createDataFrame([(n, schemas.to_ddl(n, f.schema, dialect)) for n, f in sorted(frames.items())], "table_name string, ddl string")
