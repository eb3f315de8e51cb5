"""A session for VectorSQL: tables of one database, an embedder, statements with a time limit."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector
from .functions.compat import Unsupported
from .operators import search_function
from .operators.vectorize import Embedder
from .plans.classify import with_level
from .plans.vectorsql import VectorSqlError, rewrite
from .sources import catalog


#: What is kept of a statement that ran.
STATUS = "id string, sql string, status string, columns array<string>, row_count long, message string, path string"


@dataclass
class QueryResult:
    """status success or error; the rows stay a lazy frame unless they were collected."""

    status: str
    columns: list[str]
    frame: DataFrame | None = None
    data: list | None = None
    message: str | None = None

    @property
    def row_count(self) -> int | None:
        return None if self.data is None else len(self.data)


class VectorSession:
    """model names are aliases of the embedders given; unknown ones fall back to ``default``.

    metric is that of the vector indexes: what ``distance()`` computes in MyScale's dialect.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, embedders: dict[str, Embedder] | None = None, default: Embedder | None = None, tables: tuple[str, ...] | None = None, metric: str = "l2"):
        self.spark, self.embedders, self.default = spark, embedders or {}, default
        self._memo: dict[tuple[str, str], list[float]] = {}
        vector.register(spark, metric)
        search_function.register(spark)
        if folder:
            found = tables or tuple(catalog.discover(spark, folder))
            catalog.register(spark, folder, found)

    def columns_of(self, table: str) -> list[str]:
        try:
            return self.spark.table(table).columns
        except PySparkException:
            return []

    def embed(self, pairs: list[tuple[str, str]]) -> None:
        """One call per model for the texts not yet known."""
        for model in {m for m, _ in pairs}:
            texts = sorted({t for m, t in pairs if m == model and (m, t) not in self._memo})
            if texts:
                embedder = self.embedders.get(model, self.default)
                if embedder is None:
                    raise VectorSqlError(f"no embedder for model {model}")
                self._memo |= {(model, t): list(map(float, v)) for t, v in zip(texts, embedder.embed(texts))}

    def sql(self, text: str, dialect: str = "sqlite") -> DataFrame:
        """The lazy frame of a statement in one of the four dialects."""
        s = rewrite(text, dialect, self.columns_of)
        self.embed(s.embeddings)
        args = {f"v{i}": vector.vector(self._memo[p]) for i, p in enumerate(s.embeddings)} | {k: vector.vector(v) for k, v in s.vectors.items()}
        return self.spark.sql(s.sql, args=args) if args else self.spark.sql(s.sql)

    def validate(self, text: str, dialect: str = "sqlite") -> tuple[str, str | None]:
        """(status, error): whether Spark can analyse the statement; nothing runs."""
        try:
            self.sql(text, dialect).schema
        except (PySparkException, VectorSqlError, Unsupported) as e:
            return "error", str(e).splitlines()[0]
        return "success", None

    def execute(self, text: str, dialect: str = "sqlite", timeout: float = 60.0, limit: int | None = None) -> QueryResult:
        """Runs a statement; its jobs are cancelled by tag once the time is up."""
        tag = f"vsql-{uuid.uuid4().hex}"
        done, expired = threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(timeout):
                expired.set()
                self.spark.interruptTag(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        self.spark.addTag(tag)
        watcher.start()
        try:
            frame = self.sql(text, dialect)
            rows = frame.collect() if limit is None else frame.limit(limit).collect()
            return QueryResult("success", frame.columns, frame, [tuple(r) for r in rows])
        except (PySparkException, VectorSqlError, Unsupported) as e:
            return QueryResult("error", [], message="timed out" if expired.is_set() else str(e))
        except Exception as e:  # a cancelled job surfaces as the gateway's own error
            if not expired.is_set():
                raise
            return QueryResult("error", [], message=f"timed out: {type(e).__name__}")
        finally:
            done.set()
            self.spark.removeTag(tag)

    def execute_all(self, statements: list[tuple[str, str]], dialect: str = "sqlite", timeout: float = 60.0, threads: int = 8) -> dict[str, QueryResult]:
        """(query_id, statement) pairs, side by side; Spark schedules their jobs."""
        with ThreadPoolExecutor(threads) as pool:
            found = pool.map(lambda s: (s[0], self.execute(s[1], dialect, timeout)), statements)
            return dict(found)

    def run_into(self, text: str, path: str, dialect: str = "sqlite", timeout: float = 60.0) -> dict:
        """Runs a statement; its rows go to path as (pos, row), row in JSON, and never to the driver. Returns status, columns, row_count and message."""
        tag, done, expired = f"vsql-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(timeout):
                expired.set()
                self.spark.interruptTag(tag)

        self.spark.addTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        try:
            frame = self.sql(text, dialect)
            names = [f"c{i}" for i in range(len(frame.columns))]
            renamed = frame.toDF(*names)  # columns may share a name
            rows = renamed.select(F.monotonically_increasing_id().alias("pos"), F.to_json(F.array(*[F.col(n).cast("string") for n in names])).alias("row"))
            rows.write.mode("overwrite").parquet(path)
            return {"status": "success", "columns": frame.columns, "row_count": self.spark.read.parquet(path).count(), "message": None}
        except Exception as e:  # noqa: BLE001  a cancelled job surfaces as the gateway's own error
            if not expired.is_set() and not isinstance(e, (PySparkException, VectorSqlError, Unsupported)):
                raise
            return {"status": "error", "columns": [], "row_count": None, "message": "timed out" if expired.is_set() else str(e).splitlines()[0]}
        finally:
            done.set()
            self.spark.removeTag(tag)

    def run_statements(self, statements: DataFrame, folder: str, dialect: str = "sqlite", sql_col: str = "sql", timeout: float = 60.0, threads: int = 8, flush: int = 32) -> DataFrame:
        """Runs each distinct statement of a table once. Returns what is known of them: id (MD5 of the text), sql, status, columns, row_count, message, path.

        Statements stream to the driver, which has ``threads`` of them in hand, each in a scheduler pool of its own; their rows stay in
        ``folder``. Every ``flush`` results are appended to a table there, so a run that broke off is resumed by
        running it again: statements with a result, an error too, aren't run anew.
        """
        folder = folder.rstrip("/")
        known, lock, held = f"{folder}/status", threading.Lock(), []
        have = self._status(known)
        todo = statements.filter(F.col(sql_col).isNotNull()).select(F.md5(sql_col).alias("id"), F.col(sql_col).alias("sql")).dropDuplicates(["id"])
        if have is not None:
            todo = todo.join(have.select("id"), "id", "left_anti")
        room, pool, running = threading.BoundedSemaphore(threads), ThreadPoolExecutor(threads), []

        def keep(rows: list[tuple]) -> None:
            if rows:
                self.spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(known)

        def one(name: str, text: str) -> None:
            try:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"vsql-{threading.get_ident()}")
                path = f"{folder}/rows/{name}"
                r = self.run_into(text, path, dialect, timeout)
                row = (name, text, r["status"], r["columns"], r["row_count"], r["message"], path if r["status"] == "success" else None)
                with lock:
                    held.append(row)
                    full = held[:] if len(held) >= flush else []
                    if full:
                        held.clear()
                    keep(full)
            finally:
                room.release()

        try:
            for row in todo.toLocalIterator():
                room.acquire()
                running = [f for f in running if not f.done() or f.result()]
                running.append(pool.submit(one, row["id"], row["sql"]))
            for f in running:
                f.result()
        finally:
            pool.shutdown(wait=True)
            keep(held)
        have = self._status(known)
        return have if have is not None else self.spark.createDataFrame([], STATUS)

    def _status(self, path: str) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(STATUS).parquet(path).dropDuplicates(["id"])

    def run_cases(self, cases: list[dict] | DataFrame, folder: str, dialect: str = "sqlite", timeout: float = 60.0, threads: int = 8, schema: str | None = None) -> DataFrame:
        """Runs the predicted statement of each case and every gold one; a row for each.

        cases: query_id, predicted_sql and sql_candidate (else sql), as read from a case file or a table of it. Columns: query_id,
        run_id (-1 for the prediction), sql, integration_level, status, columns, row_count, message,
        path, where the rows lie, db_type and schema, the text that describes the database. A case without a prediction has an error. Equal statements run once; a
        broken run is resumed as in ``run_statements``.
        """
        if not isinstance(cases, DataFrame):
            cases = self.spark.createDataFrame([(str(c["query_id"]), c.get("predicted_sql"), c.get("sql_candidate"), c.get("sql")) for c in cases], "query_id string, predicted_sql string, sql_candidate array<string>, sql string")
        have = set(cases.columns)
        gold = F.when(F.size("sql_candidate") > 0, F.col("sql_candidate")) if "sql_candidate" in have else F.lit(None).cast("array<string>")
        single = F.when(F.col("sql").isNotNull(), F.array("sql")) if "sql" in have else F.lit(None).cast("array<string>")
        wanted = F.concat(F.array("predicted_sql"), F.coalesce(gold, single, F.array().cast("array<string>")))
        runs = cases.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode(wanted).alias("i", "sql")).withColumn("run_id", F.col("i") - 1).drop("i")
        found = self.run_statements(runs, folder, dialect, "sql", timeout, threads).select(F.col("sql").alias("__s"), "status", "columns", "row_count", "message", "path")
        out = with_level(runs.join(found, F.col("sql") == F.col("__s"), "left").drop("__s"))
        none = F.col("sql").isNull()
        return out.select(
            "query_id", "run_id", "sql", "integration_level", F.when(none, "error").otherwise(F.col("status")).alias("status"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "row_count",
            F.when(none, "no predicted statement").otherwise(F.col("message")).alias("message"), "path", F.lit(dialect).alias("db_type"), F.lit(schema).cast("string").alias("schema"),
        )

    def runnable(self, statements: DataFrame, folder: str, dialect: str = "sqlite", sql_col: str = "sql", timeout: float = 60.0) -> DataFrame:
        """Keeps statements that run, with their column_count and row_count. For curated statement sets, of which one per template is enough."""
        known = self.run_statements(statements, folder, dialect, sql_col, timeout).filter("status = 'success'")
        known = known.select(F.col("sql").alias("__s"), F.size("columns").alias("column_count"), "row_count")
        return statements.join(known, F.col(sql_col) == F.col("__s")).drop("__s")
