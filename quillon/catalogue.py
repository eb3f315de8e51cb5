"""Queries of the reference-side operators and their DuckDB twins.

A query is registered with ``@query(sql)``; where one SQL text means the same in both
engines, ``both(name, sql)`` registers it for either.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compat, vector
from .operators import corpus, knn, metrics, ranks, search_function, vectorize
from .plans import classify
from .session import VectorSession
from .sources import catalog, dump, files, migrate, schemas, sqlite
from .streaming import jobs, state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return put


def both(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _tables(spark, sf_dir)
        return spark.sql(sql)

    _QUERIES[name], _ORACLES[name] = run, sql


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _tables(spark: SparkSession, sf_dir: str) -> None:
    catalog.register(spark, sf_dir)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession) -> str:
    """A fresh folder for results, in the shared one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
    return f"{at.rstrip('/')}/results-{uuid.uuid4().hex}"


def _vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(_read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


# ---- vector search -------------------------------------------------------------------------------------------------
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_D = "list_distance(embedding::DOUBLE[], " + _Q + ")"
_NEAR = "SELECT vec_id, label, " + _D.format(17) + " AS d FROM embeddings"


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.knn(e, "embedding", _vector_of(spark, sf_dir, 17), 10, "vec_id").select("vec_id", "label", "distance"))


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM ({_NEAR}) WHERE label = 3 ORDER BY d, vec_id LIMIT 10")
def knn_prefilter(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.knn(e, "embedding", _vector_of(spark, sf_dir, 17), 10, "vec_id", where=F.col("label") == 3).select("vec_id", "label", "distance"))


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT * FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 50) WHERE label = 3")
def knn_postfilter(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.knn(e, "embedding", _vector_of(spark, sf_dir, 17), 50, "vec_id").filter("label = 3").select("vec_id", "label", "distance"))


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM ({_NEAR}) WHERE d < 1.25")
def knn_threshold(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.within(e, "embedding", _vector_of(spark, sf_dir, 17), 1.25).select("vec_id", "label", "distance"))


@query(f"SELECT vec_id, round({_D.format(17)} + {_D.format(23)}, 6) AS distance FROM embeddings ORDER BY {_D.format(17)} + {_D.format(23)}, vec_id LIMIT 10")
def knn_sum_of_distances(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    d = sum((vector.l2(F.col("embedding"), vector.vector(_vector_of(spark, sf_dir, i))) for i in (17, 23)), F.lit(0.0))
    return _out(e.select("vec_id", d.alias("distance")).orderBy("distance", "vec_id").limit(10))


@query("SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, -list_inner_product(embedding::DOUBLE[], " + _Q.format(17) + ") AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_neg_ip(spark, sf_dir):
    return _out(knn.knn(_read(spark, sf_dir, "embeddings"), "embedding", _vector_of(spark, sf_dir, 17), 10, "vec_id", "ip").select("vec_id", "distance"))


@query("SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], " + _Q.format(17) + ") AS d FROM embeddings) ORDER BY round(d, 9), vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    out = e.select("vec_id", vector.cosine_distance(F.col("embedding"), vector.vector(_vector_of(spark, sf_dir, 17))).alias("distance"))
    return _out(out.orderBy(F.round("distance", 9), "vec_id").limit(10))


@query(f"SELECT vec_id, label, round(d, 6) AS distance, doc_id, lang, n_chars FROM (SELECT * FROM ({_NEAR}) WHERE label IN (1, 2, 3) ORDER BY d, vec_id LIMIT 5) JOIN documents ON vec_id = doc_id")
def knn_join_relational(spark, sf_dir):
    e, d = _read(spark, sf_dir, "embeddings"), _read(spark, sf_dir, "documents")
    near = knn.knn(e, "embedding", _vector_of(spark, sf_dir, 17), 5, "vec_id", where=F.col("label").isin(1, 2, 3))
    near = F.broadcast(near.select("vec_id", "label", "distance"))  # five rows
    return _out(d.join(near, F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "distance", "doc_id", "lang", "n_chars"))


@query(f"SELECT label, count(*) AS n, round(avg(d), 6) AS avg_distance, round(min(d), 6) AS least FROM (SELECT * FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 100) GROUP BY label")
def knn_group_agg(spark, sf_dir):
    near = knn.knn(_read(spark, sf_dir, "embeddings"), "embedding", _vector_of(spark, sf_dir, 17), 100, "vec_id")
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("avg_distance"), F.round(F.min("distance"), 6).alias("least"))


@query(f"SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT vec_id FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 20)")
def knn_in_subquery(spark, sf_dir):
    near = knn.knn(_read(spark, sf_dir, "embeddings"), "embedding", _vector_of(spark, sf_dir, 17), 20, "vec_id").select("vec_id")
    return _read(spark, sf_dir, "documents").join(F.broadcast(near), F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id", "lang", "n_chars")


_TOP = "(SELECT vec_id FROM embeddings ORDER BY " + _D + ", vec_id LIMIT 100)"


@query(f"{_TOP.format(17)} INTERSECT {_TOP.format(23)}")
def knn_multi_intersect(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    a, b = (knn.knn(e, "embedding", _vector_of(spark, sf_dir, i), 100, "vec_id").select("vec_id") for i in (17, 23))
    return a.intersect(b)


@query(
    "WITH hit AS (SELECT vec_id AS h, embedding::DOUBLE[] AS q FROM embeddings WHERE label = 2 ORDER BY " + _D.format(17) + ", vec_id LIMIT 1) "
    "SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, hit ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10"
)
def knn_interdependent(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    hit = knn.knn(e, "embedding", _vector_of(spark, sf_dir, 17), 1, "vec_id", where=F.col("label") == 2).select("embedding")
    return _out(knn.knn_of(e, "embedding", hit, 10, "vec_id").select("vec_id", "distance"))


@query(
    "SELECT query_key, key, round(d, 6) AS distance, rank FROM (SELECT a.vec_id AS query_key, b.vec_id AS key, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank "
    "FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) WHERE rank <= 3"
)
def knn_join_top3(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.knn_join(e, e.filter("vec_id % 20 = 0"), 3, "vec_id", "embedding"))


@query(
    "SELECT query_key, key, round(d, 6) AS distance, rank FROM (SELECT a.vec_id AS query_key, b.vec_id AS key, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank "
    "FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5"
)
def knn_join_all(spark, sf_dir):
    """The five nearest of every vector, a table against itself."""
    e = _read(spark, sf_dir, "embeddings")
    return _out(knn.knn_join(e, e, 5, "vec_id", "embedding"))


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM (" + _NEAR + ")) WHERE rank <= 3")
def knn_top_per_group(spark, sf_dir):
    near = knn.with_distance(_read(spark, sf_dir, "embeddings"), "embedding", _vector_of(spark, sf_dir, 17))
    return knn.top_per_group(near, "label", 3, "distance", "vec_id").select("label", "vec_id", "rank")


@query("SELECT label, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS avg_norm, count(*) AS n FROM embeddings GROUP BY label")
def vector_norms_by_label(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(vector.norm(F.col("embedding"))), 6).alias("avg_norm"), F.count("*").alias("n"))


@query(
    'SELECT "group", key, total FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY total, key) AS r FROM (SELECT a.label AS "group", a.vec_id AS key, '
    "round(sum(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2)) WHERE r = 1"
)
def medoid_per_label(spark, sf_dir):
    return knn.medoids(_read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("SELECT vec_id, round(list_sum(list_resize(embedding::DOUBLE[], 80, 0.0)), 5) AS total, 80 AS width, round(list_sum((embedding::DOUBLE[])[1:16]), 5) AS head FROM embeddings")
def dim_pad_truncate(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    add = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5)
    wide = vector.resize(F.col("embedding"), 80)
    return e.select("vec_id", add(wide).alias("total"), F.size(wide).alias("width"), add(vector.resize(F.col("embedding"), 16)).alias("head"))


@query("SELECT vec_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def decode_blob_vectors(spark, sf_dir):
    pack = F.pandas_udf(lambda s: s.map(lambda v: v.astype("<f4").tobytes()), "binary")
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", vectorize.decode_vector(pack("embedding")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dim"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query(f"SELECT vec_id, round({_D.format(17)}, 6) AS distance FROM embeddings ORDER BY {_D.format(17)}, vec_id LIMIT 10")
def index_search(spark, sf_dir):
    """An inverted file of all vectors, searched for all that its codes can't rule out: as exact as a search without it."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = knn.VectorIndex.build(e, "vec_id", "embedding", _folder(spark), queries=F.col("vec_id") % 20 == 0)
    return _out(index.search(spark, "embedding", _vector_of(spark, sf_dir, 17), 10, exact=True).select("vec_id", "distance"))


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recall_reached, true AS reads_a_fifth FROM embeddings")
def index_recall(spark, sf_dir):
    """The index as it searches by default, against exact search: at least 0.9 of the ten nearest, with a fifth of the rows read in full at most."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 20 = 0")
    index = knn.VectorIndex.build(e, "vec_id", "embedding", _folder(spark), queries=F.col("vec_id") % 20 == 0)
    got = index.search_all(asked, "vec_id", "embedding", 10).select("query_key", "key")
    want = knn.knn_join(e, asked, 10, "vec_id", "embedding", skip_self=False).select("query_key", "key")
    hits = want.join(got.withColumn("hit", F.lit(1)), ["query_key", "key"], "left")
    few = F.lit(index.taken_for(10)) <= F.lit(e.count()) / 5
    return hits.agg(F.countDistinct("query_key").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached")).withColumn("reads_a_fifth", few)


@query(f"SELECT vec_id FROM embeddings WHERE label < 5 ORDER BY {_D.format(17)}, vec_id LIMIT 6")
def match_dialect_literal_vector(spark, sf_dir):
    """The vector stands in the statement itself."""
    session = VectorSession(spark, sf_dir, tables=("embeddings",))
    return session.sql(f"SELECT vec_id FROM embeddings WHERE embedding MATCH '{_vector_of(spark, sf_dir, 17)}' AND k = 6 AND label < 5")


@query(f"SELECT vec_id, round({_D.format(17)}, 6) AS first, round({_D.format(23)}, 6) AS second, round({_D.format(31)}, 6) AS other FROM embeddings")
def model_aliases(spark, sf_dir):
    """Two models by name, and the default one for a name that isn't known."""
    named = {m: vectorize.TableEmbedder({"x": _vector_of(spark, sf_dir, i)}, 64) for m, i in (("first", 17), ("second", 23), ("other", 31))}
    session = VectorSession(spark, sf_dir, {m: named[m] for m in ("first", "second")}, named["other"], ("embeddings",))
    return session.sql("SELECT vec_id, round(L2Distance(embedding, lembed('first', 'x')), 6) AS first, round(L2Distance(embedding, lembed(second, 'x')), 6) AS second, round(L2Distance(embedding, lembed('third', 'x')), 6) AS other FROM embeddings", "clickhouse")


# ---- the four dialects ---------------------------------------------------------------------------------------------
class _Known(vectorize.TableEmbedder):
    """Texts "vec N" stand for vector N of embeddings."""


def _session(spark: SparkSession, sf_dir: str, metric: str = "l2") -> VectorSession:
    known = {f"vec {i}": _vector_of(spark, sf_dir, i) for i in (17, 23)}
    return VectorSession(spark, sf_dir, default=_Known(known, 64), tables=catalog.TABLES, metric=metric)


def _statement(name: str, text: str, dialect: str, oracle: str, metric: str = "l2") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir, metric).sql(text, dialect)

    _QUERIES[name], _ORACLES[name] = run, oracle


_statement(
    "match_dialect_k",
    "SELECT e.vec_id, e.label, ROUND(e.distance, 6) AS distance FROM embeddings e WHERE e.embedding MATCH lembed('all-MiniLM-L6-v2', 'vec 17') AND e.k = 7 AND e.label BETWEEN 2 AND 5",
    "sqlite",
    f"SELECT vec_id, label, round(d, 6) AS distance FROM ({_NEAR}) WHERE label BETWEEN 2 AND 5 ORDER BY d, vec_id LIMIT 7",
)
_statement(
    "match_dialect_limit",
    'SELECT vec_id, ROUND(distance, 6) AS distance FROM embeddings WHERE embedding MATCH lembed("all-MiniLM-L6-v2", "vec 17") ORDER BY distance LIMIT 6',
    "sqlite",
    f"SELECT vec_id, round(d, 6) AS distance FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 6",
)
_NEAR_E = f"(SELECT vec_id, label, d FROM ({_NEAR}))"
_statement(
    "match_dialect_join_limit",
    "SELECT e.vec_id, l.l_linenumber FROM embeddings e JOIN lineitem l ON e.vec_id = l.l_partkey WHERE e.embedding MATCH lembed('m', 'vec 17') AND e.label <> 4 ORDER BY e.distance, e.vec_id, l.l_orderkey, l.l_linenumber LIMIT 5",
    "sqlite",
    f"SELECT vec_id, l_linenumber FROM (SELECT * FROM {_NEAR_E} WHERE label <> 4 ORDER BY d, vec_id LIMIT 5) JOIN lineitem ON vec_id = l_partkey ORDER BY d, vec_id, l_orderkey, l_linenumber LIMIT 5",
)
_statement(
    "match_dialect_distinct_limit",
    "SELECT DISTINCT label % 3 AS third FROM embeddings WHERE embedding MATCH lembed('m', 'vec 17') ORDER BY third LIMIT 2",
    "sqlite",
    f"SELECT DISTINCT label % 3 AS third FROM (SELECT * FROM {_NEAR_E} ORDER BY d, vec_id LIMIT 2) ORDER BY third LIMIT 2",
)
_statement(
    "match_dialect_offset",
    "SELECT vec_id, ROUND(distance, 6) AS distance FROM embeddings WHERE embedding MATCH lembed('m', 'vec 17') ORDER BY distance, vec_id LIMIT 5 OFFSET 3",
    "sqlite",
    f"SELECT vec_id, round(d, 6) AS distance FROM {_NEAR_E} ORDER BY d, vec_id LIMIT 5 OFFSET 3",
)
_statement(
    "match_dialect_join",
    "SELECT d.doc_id, d.lang, ROUND(e.distance, 6) AS distance FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding MATCH lembed('m', 'vec 17') AND e.k = 20 AND d.lang = 'en'",
    "sqlite",
    f"SELECT doc_id, lang, round(d, 6) AS distance FROM (SELECT * FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 20) JOIN documents ON doc_id = vec_id WHERE lang = 'en'",
)
_statement(
    "match_dialect_dotted_literal",
    "SELECT e.vec_id, 'Dr. Smith . x' AS a, '(?s)it''s \\d' AS b, e.label || '. ' AS c FROM embeddings e WHERE e.embedding MATCH lembed('m', 'vec 17') AND e.k = 20 AND e.label || '. x' LIKE '%. X'",
    "sqlite",
    f"SELECT vec_id, 'Dr. Smith . x' AS a, '(?s)it''s \\d' AS b, label || '. ' AS c FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 20",
)
_statement(
    "my_dialect_cosine",
    "WITH lembed('m', 'vec 17') AS a SELECT vec_id, round(distance(embedding, a), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 8",
    "myscale",
    f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q.format(17)}), 6) AS distance FROM embeddings ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q.format(17)}), 6), vec_id LIMIT 8",
    metric="cosine",
)
_statement(
    "match_dialect_two_searches",
    "WITH a AS (SELECT vec_id FROM embeddings WHERE embedding MATCH lembed('m', 'vec 17') AND k = 60), b AS (SELECT vec_id FROM embeddings WHERE embedding MATCH lembed('m', 'vec 23') AND k = 60) "
    "SELECT a.vec_id FROM a JOIN b ON a.vec_id = b.vec_id",
    "sqlite",
    f"SELECT a.vec_id FROM {_TOP.format(17).replace('100', '60')} a JOIN {_TOP.format(23).replace('100', '60')} b ON a.vec_id = b.vec_id",
)
_statement(
    "match_dialect_subquery_agg",
    "SELECT lang, COUNT(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE embedding MATCH lembed('m', 'vec 17') AND k = 80) GROUP BY lang",
    "sqlite",
    f"SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM ({_NEAR}) ORDER BY d, vec_id LIMIT 80) GROUP BY lang",
)
_statement(
    "pg_dialect_distance",
    'SELECT "vec_id", round("embedding" <-> lembed(\'m\', \'vec 17\'), 6) AS distance FROM "embeddings" WHERE "embedding" <-> lembed(\'m\', \'vec 17\') < 1.3 ORDER BY distance, "vec_id" LIMIT 8',
    "postgresql",
    f"SELECT vec_id, round(d, 6) AS distance FROM ({_NEAR}) WHERE d < 1.3 ORDER BY round(d, 6), vec_id LIMIT 8",
)
_statement(
    "pg_dialect_inner_product",
    "SELECT vec_id, round(embedding <#> lembed('m', 'vec 23'), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 8",
    "postgresql",
    "SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, -list_inner_product(embedding::DOUBLE[], " + _Q.format(23) + ") AS d FROM embeddings) ORDER BY round(d, 6), vec_id LIMIT 8",
)
_statement(
    "ch_dialect_scalar_with",
    "WITH lembed('m', 'vec 17') AS ref_vec_0 SELECT vec_id, round(L2Distance(embedding, ref_vec_0), 6) AS distance FROM embeddings WHERE label <> 4 ORDER BY distance, vec_id LIMIT 8",
    "clickhouse",
    f"SELECT vec_id, round(d, 6) AS distance FROM ({_NEAR}) WHERE label <> 4 ORDER BY round(d, 6), vec_id LIMIT 8",
)
_statement(
    "my_dialect_sum",
    "WITH lembed('m', 'vec 17') AS a, lembed('m', 'vec 23') AS b SELECT vec_id, round(distance(embedding, a) + distance(embedding, b), 6) AS total FROM embeddings ORDER BY total, vec_id LIMIT 8",
    "myscale",
    f"SELECT vec_id, round({_D.format(17)} + {_D.format(23)}, 6) AS total FROM embeddings ORDER BY round({_D.format(17)} + {_D.format(23)}, 6), vec_id LIMIT 8",
)

#: (level, statement): {text} and {k} stand for what a row of a table gives.
_LEVELS = (
    (0, "SELECT a FROM t WHERE b = {k}"),
    (1, "SELECT a FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k}"),
    (2, "SELECT a FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k} AND b > 3"),
    (3, "WITH s AS (SELECT a, b FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k}) SELECT a FROM s WHERE b > 3"),
    (4, "SELECT b, COUNT(a) FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k} GROUP BY b"),
    (5, "SELECT t.a FROM t JOIN u ON t.a = u.a WHERE t.e MATCH lembed('m', '{text}') AND t.k = {k}"),
    (6, "SELECT a FROM u WHERE a IN (SELECT a FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k})"),
    (7, "WITH s AS (SELECT a FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k}), r AS (SELECT a FROM t WHERE e MATCH lembed('m', 'y') AND k = 5) SELECT s.a FROM s, r"),
    (9, "WITH s AS (SELECT a FROM t WHERE e MATCH lembed('m', '{text}') AND k = {k}) SELECT v.a FROM s, v WHERE v.e MATCH lembed('m', 'y') AND v.k = 5"),
    (9, "SELECT u.b, COUNT(t.a) FROM t JOIN u ON t.a = u.a WHERE t.e MATCH lembed('m', '{text}') AND t.k = {k} GROUP BY u.b"),
)
_COMPLEX = (
    ("Simple", "SELECT count(*) FROM t WHERE a = '{text}'"),
    ("Moderate", "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > {k}"),
    ("Complex", "SELECT a, row_number() OVER (ORDER BY a) FROM t WHERE a <> '{text}'"),
    ("Highly Complex", "WITH RECURSIVE r AS (SELECT {k} UNION ALL SELECT 2) SELECT * FROM r"),
)


def _written(spark: SparkSession, sf_dir: str, forms: tuple) -> DataFrame:
    """(doc_id, form, sql): each form filled with the opening of every document and a number from its id."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.replace(F.substring("text", 1, 60), F.lit("'"), F.lit("''")).alias("text"), (F.col("doc_id") % 50 + 1).cast("string").alias("k"))
    each = F.array(*[F.struct(F.lit(i).alias("form"), corpus.fill(s, text="text", k="k").alias("sql")) for i, (_, s) in enumerate(forms)])
    return d.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.form", "x.sql")


def _expected(forms: tuple, name: str) -> str:
    values = ", ".join(f"({i}, {n!r})" for i, (n, _) in enumerate(forms))
    return f"SELECT doc_id, form, {name} FROM documents, (VALUES {values}) AS v(form, {name})"


@query(_expected(_LEVELS, "integration_level"))
def integration_levels(spark, sf_dir):
    """Statements written from every document: what the texts say, keywords among it, doesn't change the level."""
    return classify.with_level(_written(spark, sf_dir, _LEVELS)).select("doc_id", "form", "integration_level")


@query(_expected(_COMPLEX, "complexity"))
def complexity_ladder(spark, sf_dir):
    return _written(spark, sf_dir, _COMPLEX).select("doc_id", "form", classify.complexity(F.col("sql")).alias("complexity"))


# ---- relational surface --------------------------------------------------------------------------------------------
both("project_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
both("filter_surface", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_orderpriority LIKE '%H%'")
both("exists_not_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("join_inner_multi", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
both("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
both("join_full", "SELECT a.c_custkey AS rich, b.c_custkey AS building FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey")
both("join_cross", "SELECT r_name, o_orderstatus FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)")
both("join_self", "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_implicit", "SELECT n_name, s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0")
both("join_text_key", "SELECT count(*) AS n FROM orders JOIN (SELECT CAST(c_custkey AS VARCHAR(20)) AS k FROM customer) ON CAST(o_custkey AS VARCHAR(20)) = k")
both("agg_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
both("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
both("agg_cube", "SELECT r_name, c_mktsegment, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY CUBE (r_name, c_mktsegment)")
both("agg_rollup_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
both("agg_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority")
@query(
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 6) AS pr, round(cume_dist() OVER p, 6) AS cd, ntile(4) OVER w AS q "
    "FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
)
def win_ranks(spark, sf_dir):
    """Three statuses hold all orders, so windows over them would run in three tasks, each with all the rows of one."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    out = ranks.ranked(o, "o_orderstatus", [F.col(c).asc_nulls_last() for c in ("o_totalprice", "o_orderkey")], "o_orderpriority", 4, 6)
    names = {"rn": "row_number", "rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist", "q": "ntile"}
    return out.select("o_orderkey", *[F.col(c).alias(name) for name, c in names.items()])


both(
    "win_offsets",
    "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS prev, lead(o_totalprice) OVER w AS next, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last, nth_value(o_totalprice, 2) OVER w AS second "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
both("win_frames", f"SELECT o_orderkey, CAST(sum({_CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving_cents, avg({_CENTS}) OVER (PARTITION BY o_custkey) AS mean_cents FROM orders")
both("cte_multi", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 100000) SELECT c_mktsegment, count(*) AS n, round(sum(total), 2) AS total FROM top JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
both(
    "cte_recursive",
    "WITH RECURSIVE r(supplier, depth, path_total) AS (SELECT s_suppkey, 0, CAST(s_acctbal AS DECIMAL(18, 2)) FROM supplier WHERE s_suppkey = 1 "
    "UNION ALL SELECT s.s_suppkey, r.depth + 1, CAST(r.path_total + CAST(s.s_acctbal AS DECIMAL(18, 2)) AS DECIMAL(18, 2)) FROM supplier s JOIN r ON s.s_suppkey >= 2 * r.supplier AND s.s_suppkey <= 2 * r.supplier + 1) "
    "SELECT supplier, depth, CAST(path_total AS DOUBLE) AS path_total FROM r",
)
both("subquery_scalar", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
both("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("setop_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("setop_union_all", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
both("setop_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("setop_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
both("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("top_per_group", "SELECT o_orderstatus, o_orderkey, rn FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
both(
    "revenue_by_nation",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
)


# ---- functions -----------------------------------------------------------------------------------------------------
def _functions(name: str, table: str, key: str, calls: dict[str, tuple[str, str]]) -> None:
    """calls: alias -> (VectorSQL expression in the SQLite dialect, DuckDB expression)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = f"SELECT {key}, " + ", ".join(f"{lite} AS {alias}" for alias, (lite, _) in calls.items()) + f" FROM {table}"
        return VectorSession(spark, sf_dir, tables=(table,)).sql(text)

    _QUERIES[name] = run
    _ORACLES[name] = f"SELECT {key}, " + ", ".join(f"{duck} AS {alias}" for alias, (_, duck) in calls.items()) + f" FROM {table}"


_functions("fn_string", "customer", "c_custkey", {
    "f_hex": ("HEX(c_mktsegment)", "hex(c_mktsegment)"),
    "f_instr": ("INSTR(c_name, '#')", "instr(c_name, '#')"),
    "f_length": ("LENGTH(c_name)", "length(c_name)"),
    "f_lower": ("LOWER(c_mktsegment)", "lower(c_mktsegment)"),
    "f_upper": ("UPPER(c_name)", "upper(c_name)"),
    "f_ltrim": ("LTRIM(c_name, 'Cu')", "ltrim(c_name, 'Cu')"),
    "f_rtrim": ("RTRIM(c_name, '0123')", "rtrim(c_name, '0123')"),
    "f_trim": ("TRIM(c_mktsegment, 'BG')", "trim(c_mktsegment, 'BG')"),
    "f_replace": ("REPLACE(c_name, '0', 'o')", "replace(c_name, '0', 'o')"),
    "f_substr": ("SUBSTR(c_name, 3, 4)", "substr(c_name, 3, 4)"),
    "f_substr0": ("SUBSTR(c_name, 0, 3)", "substr(c_name, 1, 2)"),
    "f_concat": ("CONCAT(c_name, NULL, '-')", "concat(c_name, NULL, '-')"),
    "f_concat_ws": ("CONCAT_WS('/', c_name, c_mktsegment)", "concat_ws('/', c_name, c_mktsegment)"),
    "f_like": ("c_mktsegment LIKE 'build%'", "c_mktsegment ILIKE 'build%'"),
    "f_glob": ("c_mktsegment GLOB 'B*G'", "c_mktsegment GLOB 'B*G'"),
    "f_unicode": ("UNICODE(c_mktsegment)", "unicode(c_mktsegment)"),
    "f_char": ("CHAR(72, 233, 8364)", "concat(chr(72), chr(233), chr(8364))"),
    "f_quote": ("QUOTE(c_mktsegment)", "concat('''', c_mktsegment, '''')"),
    "f_octets": ("OCTET_LENGTH(c_name)", "strlen(c_name)"),
    "f_typeof": ("TYPEOF(c_acctbal)", "'real'"),
    "f_soundex": ("SOUNDEX('Robert')", "'R163'"),
})
_functions("fn_null", "customer", "c_custkey", {
    "f_coalesce": ("COALESCE(NULL, c_mktsegment)", "coalesce(NULL, c_mktsegment)"),
    "f_ifnull": ("IFNULL(NULLIF(c_nationkey, 3), -1)", "ifnull(nullif(c_nationkey, 3), -1)"),
    "f_iif": ("IIF(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"),
    "f_max": ("MAX(c_nationkey, 10)", "greatest(c_nationkey, 10)"),
    "f_min": ("MIN(c_nationkey, 10)", "least(c_nationkey, 10)"),
    "f_likely": ("LIKELY(c_acctbal > 0)", "c_acctbal > 0"),
})
_functions("fn_math", "part", "p_partkey", {
    "f_abs": ("ABS(0 - p_retailprice)", "abs(p_retailprice)"),
    "f_round": ("ROUND(p_retailprice, 1)", "round(p_retailprice, 1)"),
    "f_sign": ("SIGN(p_size - 25)", "CAST(sign(p_size - 25) AS INT)"),
    "f_log": ("ROUND(LOG(p_size), 9)", "round(log10(p_size), 9)"),
    "f_log_b": ("ROUND(LOG(2, p_size), 9)", "round(log2(p_size), 9)"),
    "f_ln": ("ROUND(LN(p_size), 9)", "round(ln(p_size), 9)"),
    "f_exp": ("ROUND(EXP(p_size / 50.0), 9)", "round(exp(p_size / 50.0), 9)"),
    "f_pow": ("ROUND(POW(p_size, 1.5), 6)", "round(pow(p_size, 1.5), 6)"),
    "f_sqrt": ("ROUND(SQRT(p_size), 9)", "round(sqrt(p_size), 9)"),
    "f_mod": ("MOD(p_size, 7)", "p_size % 7"),
    "f_trunc": ("TRUNC(p_retailprice)", "CAST(trunc(p_retailprice) AS BIGINT)"),
    "f_ceil": ("CEIL(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"),
    "f_floor": ("FLOOR(p_retailprice)", "CAST(floor(p_retailprice) AS BIGINT)"),
    "f_acos": ("ROUND(ACOS(p_size / 40.0), 9)", "CASE WHEN p_size <= 40 THEN round(acos(p_size / 40.0), 9) END"),
    "f_sin": ("ROUND(SIN(p_size) + COS(p_size) + TAN(0.5) + ATAN(p_size), 9)", "round(sin(p_size) + cos(p_size) + tan(0.5) + atan(p_size), 9)"),
    "f_hyper": ("ROUND(SINH(0.5) + COSH(0.5) + TANH(0.5) + ASINH(p_size), 9)", "round(sinh(0.5) + cosh(0.5) + tanh(0.5) + asinh(p_size), 9)"),
    "f_deg": ("ROUND(DEGREES(p_size) + RADIANS(p_size) + PI() + ATAN2(p_size, 2), 6)", "round(degrees(p_size) + radians(p_size) + pi() + atan2(p_size, 2), 6)"),
})
_functions("fn_more", "part", "p_partkey", {
    "f_printf": ("PRINTF('%05d', p_size)", "printf('%05d', p_size)"),
    "f_format": ("FORMAT('%d-%d', p_partkey, p_size)", "concat(p_partkey, '-', p_size)"),
    "f_unhex": ("OCTET_LENGTH(UNHEX(HEX(p_partkey)))", "strlen(CAST(p_partkey AS VARCHAR))"),
    "f_zeroblob": ("OCTET_LENGTH(ZEROBLOB(p_size))", "p_size"),
    "f_acosh": ("ROUND(ACOSH(p_size), 9)", "round(acosh(p_size), 9)"),
    "f_asin": ("ROUND(ASIN(p_size / 100.0), 9)", "round(asin(p_size / 100.0), 9)"),
    "f_atanh": ("ROUND(ATANH(p_size / 100.0), 9)", "round(atanh(p_size / 100.0), 9)"),
    "f_ceiling": ("CEILING(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"),
})
_functions("fn_date", "orders", "o_orderkey", {
    "f_date": ("DATE(o_orderdate)", "strftime(o_orderdate, '%Y-%m-%d')"),
    "f_plus": ("DATE(o_orderdate, '+1 month')", "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    "f_start": ("DATE(o_orderdate, 'start of year')", "strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')"),
    "f_time": ("TIME(o_orderdate)", "strftime(o_orderdate, '%H:%M:%S')"),
    "f_datetime": ("DATETIME(o_orderdate, '-2 day')", "strftime(o_orderdate - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S')"),
    "f_julian": ("ROUND(JULIANDAY(o_orderdate), 6)", "round(epoch_us(o_orderdate) / 86400000000.0 + 2440587.5, 6)"),
    "f_epoch": ("UNIXEPOCH(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)"),
    "f_strftime": ("STRFTIME('%Y/%m week %w', o_orderdate)", "concat(strftime(o_orderdate, '%Y/%m'), ' week ', dayofweek(o_orderdate))"),
})


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(sum(o_totalprice), 2) AS total, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS names FROM orders GROUP BY o_orderstatus")
def fn_agg(spark, sf_dir):
    text = (
        "SELECT s AS o_orderstatus, SUM(n) AS n, ROUND(TOTAL(total) / SUM(n), 2) AS mean, ROUND(TOTAL(total), 2) AS total, GROUP_CONCAT(p, ',') AS names "
        "FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority) t GROUP BY s"
    )
    return VectorSession(spark, sf_dir, tables=("orders",)).sql(text)


_ENGINE = {
    "CHANGES": ("()", "0"),
    "TOTAL_CHANGES": ("()", "0"),
    "LAST_INSERT_ROWID": ("()", "refused"),
    "LOAD_EXTENSION": ("('x')", "refused"),
    "SQLITE_COMPILEOPTION_GET": ("(1)", "refused"),
    "SQLITE_COMPILEOPTION_USED": ("('x')", "refused"),
    "SQLITE_OFFSET": ("(r_regionkey)", "refused"),
    "SQLITE_SOURCE_ID": ("()", "refused"),
}


@query("SELECT name, answer, r_regionkey FROM (VALUES " + ", ".join(f"('{n}', '{a}')" for n, (_, a) in _ENGINE.items()) + ") AS v(name, answer) CROSS JOIN (SELECT r_regionkey FROM region)")
def fn_refused(spark, sf_dir):
    """Functions on the connection or the engine, called for each region: a constant, or refused before anything runs."""
    session, out = VectorSession(spark, sf_dir, tables=("region",)), None
    for name, (args, _) in _ENGINE.items():
        try:
            answer = session.sql(f"SELECT CAST({name}{args} AS TEXT) AS answer, r_regionkey FROM region")
        except compat.Unsupported:
            answer = spark.table("region").select(F.lit("refused").alias("answer"), "r_regionkey")
        part = answer.select(F.lit(name).alias("name"), "answer", "r_regionkey")
        out = part if out is None else out.unionByName(part)
    return out


# ---- metrics -------------------------------------------------------------------------------------------------------
_CASES = (
    "WITH pred AS (SELECT c_nationkey AS query_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pos, c_mktsegment AS r FROM customer), "
    "gold AS (SELECT s_nationkey AS query_id, s_suppkey % 3 AS run_id, CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'FURNITURE' ELSE 'NONE' END AS r FROM supplier), "
    "seen AS (SELECT query_id, r, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS rank FROM pred GROUP BY query_id, r), "
    "truth AS (SELECT query_id, r, count(*) AS gain FROM gold GROUP BY query_id, r), "
    "met AS (SELECT s.query_id, rank, gain, CASE WHEN gain IS NULL THEN 0 ELSE 1 END AS hit, sum(CASE WHEN gain IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.query_id ORDER BY rank) AS hits FROM seen s LEFT JOIN truth t ON s.query_id = t.query_id AND s.r = t.r), "
    "t AS (SELECT query_id, count(*) AS n_test, sum(hit) AS n_hit, sum(CASE WHEN hit = 1 THEN hits / rank END) AS ps, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 AND rank <= 10 THEN gain / log2(rank + 1.0) END) AS dcg FROM met GROUP BY query_id), "
    "g AS (SELECT query_id, count(*) AS n_gold, sum(CASE WHEN p <= 10 THEN gain / log2(p + 1.0) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS p FROM truth) GROUP BY query_id), "
    "runs AS (SELECT DISTINCT query_id, run_id, r FROM gold), "
    "ex AS (SELECT DISTINCT a.query_id FROM (SELECT u.query_id, u.run_id, count(*) AS n, count(s.r) AS b FROM runs u LEFT JOIN seen s ON s.query_id = u.query_id AND s.r = u.r GROUP BY 1, 2) a JOIN t ON t.query_id = a.query_id WHERE n = b AND b = n_test), "
    "x AS (SELECT n_nationkey AS query_id, coalesce(n_test, 0) AS nt, coalesce(n_hit, 0) AS nh, coalesce(n_gold, 0) AS ng, ps, first, dcg, idcg, ex.query_id IS NOT NULL AS exact FROM nation LEFT JOIN t ON t.query_id = n_nationkey LEFT JOIN g ON g.query_id = n_nationkey LEFT JOIN ex ON ex.query_id = n_nationkey), "
    "y AS (SELECT *, CASE WHEN nt = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE nh / nt END AS p, CASE WHEN ng = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE nh / ng END AS c FROM x), "
    "z AS (SELECT query_id, CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN exact THEN 1.0 ELSE 0.0 END AS exact_match, p AS precision, c AS recall, CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END AS f1, "
    + ", ".join(f"CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN nt = 0 OR ng = 0 THEN 0.0 ELSE coalesce({e}, 0.0) END AS {n}" for n, e in (("map", "ps / ng"), ("mrr", "1.0 / first"), ("ndcg", "dcg / idcg")))
    + " FROM y) "
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (_read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    balance = F.col("c_acctbal")  # places only say which row comes first: greatest balance, nulls last, and least key
    place = F.struct(balance.isNull().alias("none"), (~F.isnan(balance)).alias("number"), (-balance).alias("less"), "c_custkey")
    predicted = c.select(F.col("c_nationkey").alias("query_id"), place.alias("pos"), F.col("c_mktsegment").alias("row"))
    name = F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE", "NONE"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    gold = s.select(F.col("s_nationkey").alias("query_id"), (F.col("s_suppkey") % 3).alias("run_id"), F.col("s_suppkey").alias("pos"), name.alias("row"))
    return metrics.evaluate(n.select(F.col("n_nationkey").alias("query_id"), F.lit(True).alias("ok")), predicted, gold)


@query(_CASES + "SELECT query_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in metrics.SCORES) + " FROM z")
def metric_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", *[F.round(s, 6).alias(s) for s in metrics.SCORES])


@query(_CASES + "SELECT " + ", ".join(f"round(avg({s}), 6) AS average_{s}" for s in metrics.SCORES) + ", count(*) AS total_cases FROM z")
def metric_summary(spark, sf_dir):
    return metrics.summary(_scores(spark, sf_dir)).select(*[F.round(f"average_{s}", 6).alias(f"average_{s}") for s in metrics.SCORES], "total_cases")


@query(
    _CASES + ", m AS (SELECT *, CASE query_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, CASE query_id % 3 WHEN 0 THEN 'x' ELSE 'y' END AS backend FROM z) "
    "SELECT model, round(avg(CASE WHEN backend = 'x' THEN f1 END), 6) AS x_d, round(avg(CASE WHEN backend = 'y' THEN f1 END), 6) AS y_d, round((avg(CASE WHEN backend = 'x' THEN f1 END) + avg(CASE WHEN backend = 'y' THEN f1 END)) / 2, 6) AS macro_average FROM m GROUP BY model"
)
def metric_pivot(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("model", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b")).withColumn("backend", F.when(F.col("query_id") % 3 == 0, "x").otherwise("y")).withColumn("dataset", F.lit("d"))
    out = metrics.compare_models(s)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("x_d", "y_d", "macro_average")])



# ---- corpus --------------------------------------------------------------------------------------------------------
_STATEMENT = "concat('SELECT  * FROM t WHERE a = ', c_custkey, ' AND b = ''', c_mktsegment, ''' AND n', c_nationkey % 7, ' IS NOT NULL')"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.expr(r"concat('SELECT  * FROM t WHERE a = ', c_custkey, ' AND b = \'', c_mktsegment, '\' AND n', c_nationkey % 7, ' IS NOT NULL')").alias("sql"))


@query("SELECT c_custkey, lower(regexp_replace(concat('SELECT * FROM t WHERE a = <v> AND b = <v> AND n', c_nationkey % 7, ' IS NOT <v>'), '<V>', '<v>', 'g')) AS tpl FROM customer")
def template_of(spark, sf_dir):
    return _statements(spark, sf_dir).select("c_custkey", corpus.template(F.col("sql")).alias("tpl"))


@query("SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey % 7")
def template_dedup(spark, sf_dir):
    return corpus.dedup_by_template(_statements(spark, sf_dir), "sql", "c_custkey").select("c_custkey")


@query(
    "WITH r AS (SELECT DISTINCT o_custkey % 40 AS c, o_custkey AS r, o_orderstatus AS v FROM orders), k AS (SELECT c, r, string_agg(v, ',' ORDER BY v) AS s FROM r GROUP BY c, r), "
    "v AS (SELECT c, s, count(*) AS votes, min(r) AS response FROM k GROUP BY c, s), b AS (SELECT c, max(votes) AS m, sum(votes) AS n FROM v GROUP BY c) "
    "SELECT c AS \"case\", min(response) AS response, m AS votes FROM b JOIN v USING (c) WHERE n >= 3 AND votes = m GROUP BY c, m"
)
def majority_vote(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("c", F.col("o_custkey") % 40)
    return corpus.majority_vote(o, "c", "o_custkey", "o_orderstatus").select("case", "response", "votes")


@query("SELECT c_custkey FROM customer ORDER BY md5(concat('42:', c_custkey)), c_custkey LIMIT 100")
def reservoir(spark, sf_dir):
    return corpus.sample_rows(_read(spark, sf_dir, "customer").select("c_custkey"), 100, "c_custkey")


@query(
    "(SELECT s_suppkey AS id, 'small' AS part FROM supplier) UNION ALL (SELECT c_custkey, 'large' FROM customer ORDER BY md5(concat('43:', c_custkey)), c_custkey LIMIT (SELECT least(count(*) * 2, (SELECT count(*) FROM customer)) FROM supplier))"
)
def mix_ratio(spark, sf_dir):
    small = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("small").alias("part"))
    large = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("large").alias("part"))
    return corpus.mix_ratio(small, large, 1, 2, "id")


@query("SELECT c_custkey, concat('SELECT ', c_custkey) AS code, c_mktsegment AS section, concat('SELECT ', c_nationkey) AS answer, c_custkey % 2 = 0 AS is_select FROM customer")
def text_extraction(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    fenced = F.format_string("first\n```sql\nSELECT 0\n```\nthen\n```sql\nSELECT %d\n```\nend", "c_custkey")
    tagged = F.format_string("[QUESTION-START]none[QUESTION-END] and [QUESTION-START] %s [QUESTION-END]", "c_mktsegment")
    answer = F.format_string('so: {"sql": "SELECT %d"} done', "c_nationkey")
    statement = F.when(F.col("c_custkey") % 2 == 0, F.lit("-- note\n select 1")).otherwise(F.lit("DELETE FROM t -- select"))
    return c.select("c_custkey", corpus.last_code_block(fenced).alias("code"), corpus.last_section(tagged, "QUESTION").alias("section"), corpus.json_answer(answer).alias("answer"), corpus.is_query(statement).alias("is_select"))


@query("SELECT c_custkey, concat('q', row_number() OVER (ORDER BY c_custkey)) AS query_id, substring(md5(concat(c_mktsegment, '_', c_name)), 1, 16) AS hashed FROM customer")
def query_ids(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", corpus.hashed_query_id("c_mktsegment", "c_name").alias("hashed"))
    return corpus.with_query_ids(c, "c_custkey").select("c_custkey", "query_id", "hashed")


@query("SELECT n_nationkey AS query_id, n_name AS db_name, concat(n_name, '|', n_nationkey) AS sqls FROM nation")
def ground_truth(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("db_id"), F.col("n_name").alias("sql"), F.array(F.col("n_nationkey").cast("string")).alias("sql_candidate"))
    return corpus.ground_truth(n).withColumn("sqls", F.array_join("sqls", "|"))


def _nation_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, sql): a statement for each nation, of one to three columns; every fifth asks for a column that isn't there."""
    n = _read(spark, sf_dir, "nation")
    names = F.element_at(F.array(F.lit("n_name"), F.lit("n_name, n_nationkey"), F.lit("n_nationkey, n_regionkey, n_name")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    names = F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("missing, "), names)).otherwise(names)
    return n.select("n_nationkey", F.concat(F.lit("SELECT "), names, F.lit(" FROM nation WHERE n_regionkey <= "), F.col("n_regionkey").cast("string")).alias("sql"))


@query("SELECT CAST(c AS INTEGER) AS column_count, count(*) AS statements FROM (SELECT n_nationkey % 3 + 1 AS c FROM nation WHERE n_nationkey % 5 <> 4) GROUP BY c")
def column_histogram(spark, sf_dir):
    """Statements that run, by their number of columns; some fail."""
    return corpus.column_count_histogram(VectorSession(spark, sf_dir, tables=("nation",)).runnable(_nation_statements(spark, sf_dir), _folder(spark)))


@query(
    "WITH c AS (SELECT n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM nation b WHERE b.n_regionkey <= a.n_regionkey) AS n FROM nation a) "
    "SELECT k::VARCHAR AS query_id, -1 AS run_id, CASE WHEN k % 5 = 4 THEN 'error' ELSE 'success' END AS status, 0 AS integration_level, CASE WHEN k % 5 <> 4 THEN n END AS row_count, 'sqlite' AS db_type FROM c WHERE k % 7 > 0 "
    "UNION ALL SELECT k::VARCHAR, -1, 'error', NULL, NULL, 'sqlite' FROM c WHERE k % 7 = 0 "
    "UNION ALL SELECT k::VARCHAR, 0, 'success', 2, least(k % 3 + 1, (SELECT count(*) FROM embeddings WHERE label < 100)), 'sqlite' FROM c"
)
def case_runs(spark, sf_dir):
    """A case for each nation: predicted statements, some of which fail or are missing, and gold ones that search."""
    session = VectorSession(spark, sf_dir, default=vectorize.TableEmbedder({"vec 17": _vector_of(spark, sf_dir, 17)}, 64), tables=("nation", "embeddings"))
    k = F.col("n_nationkey")
    near = F.concat(F.lit("SELECT vec_id FROM embeddings WHERE embedding MATCH lembed('m', 'vec 17') AND label < 100 AND k = "), (k % 3 + 1).cast("string"))
    cases = _nation_statements(spark, sf_dir).select(k.cast("string").alias("query_id"), F.when(k % 7 > 0, F.col("sql")).alias("predicted_sql"), F.array(near).alias("sql_candidate"))
    return session.run_cases(cases, _folder(spark)).select("query_id", "run_id", "status", "integration_level", "row_count", "db_type")


@query("SELECT n_nationkey, n_name || ' ' || n_regionkey AS body, CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END AS added_later, true AS has_vector FROM nation")
def vectors_of_changed_rows(spark, sf_dir):
    """A second run embeds only what a table has gained: texts of five nations here, while those of the others are known."""
    store, early, n = _folder(spark), _folder(spark), _read(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("body"))
    vectorize.remember(rows.filter("n_nationkey >= 5"), ["body"], store, vectorize.HashEmbedder)
    spark.read.parquet(store).select("digest", F.lit(0).alias("later")).write.parquet(early)
    first = spark.read.parquet(early)
    vectorize.remember(rows, ["body"], store, vectorize.HashEmbedder)
    out = vectorize.with_vectors(rows, ["body"], store).withColumn("digest", F.sha2("body", 256)).join(first, "digest", "left")
    return out.select("n_nationkey", "body", F.coalesce("later", F.lit(1)).alias("added_later"), F.col("body_embedding").isNotNull().alias("has_vector"))


@query("SELECT id, CAST(bucket AS BIGINT) AS bucket, count(*) AS n FROM (SELECT doc_id AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '') GROUP BY 1, 2")
def hash_embed_terms(spark, sf_dir):
    return vectorize.term_counts(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "WITH q AS (SELECT unnest(['the', 'and', 'of']) AS w), t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents UNION ALL SELECT NULL, w FROM q), "
    "b AS (SELECT doc_id, ('0x' || substr(md5(w), 15, 2))::BIGINT % 64 AS i, CAST(sum(CASE WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM t WHERE w <> '' GROUP BY 1, 2), "
    "a AS (SELECT i, x FROM b WHERE doc_id IS NULL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM b WHERE doc_id IS NOT NULL GROUP BY 1 HAVING sum(x * x) > 0), "
    "d AS (SELECT b.doc_id, sum(b.x * a.x) AS dot FROM b JOIN a USING (i) WHERE b.doc_id IS NOT NULL GROUP BY 1) "
    "SELECT doc_id, round(1 - coalesce(dot, 0) / size / (SELECT sqrt(sum(x * x)) FROM a), 6) AS distance FROM n LEFT JOIN d USING (doc_id) ORDER BY 1 - coalesce(dot, 0) / size / (SELECT sqrt(sum(x * x)) FROM a), doc_id LIMIT 10"
)
def text_search_hash(spark, sf_dir):
    """Vectorized documents searched with an embedded text; the twin counts the same hashed words in SQL."""
    docs = vectorize.vectorize(_read(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], vectorize.HashEmbedder)
    q = vectorize.HashEmbedder().embed(["the and of"])[0]
    return _out(knn.knn(docs, "text_embedding", q.tolist(), 10, "doc_id", "cosine").select("doc_id", "distance"))

_DRAW = "((('0x' || substr(md5('{}:' || c_custkey), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


@query(
    f"SELECT c_custkey, CAST(ceil(ln(1 - {_DRAW.format(42)}) / ln(1 - 0.6::DOUBLE)) AS INTEGER) AS loops, "
    f"greatest(1, least(20, CAST(round(sqrt(-2 * ln({_DRAW.format(7)})) * cos(2 * pi() * {_DRAW.format(8)}) * 4 + 10) AS INTEGER))) AS tables, "
    "CASE ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT % 3 WHEN 0 THEN 'formal' WHEN 1 THEN 'vague' ELSE 'terse' END AS style FROM customer"
)
def synthesis_draws(spark, sf_dir):
    """Numbers of loops, numbers of tables and styles, drawn by the keys of rows."""
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", corpus.geometric(0.6, "c_custkey").alias("loops"), corpus.table_count(10, 4, 1, 20, "c_custkey", seed=7).alias("tables"), corpus.pick(["formal", "vague", "terse"], "c_custkey").alias("style"))


@query(
    "WITH e AS (SELECT vec_id % 180 AS c, vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT c, count(*) AS n, min(vec_id) AS least FROM e GROUP BY c), "
    "t AS (SELECT a.c, a.vec_id, round(sum(list_cosine_distance(a.v, b.v)), 6) AS total FROM e a JOIN e b ON a.c = b.c GROUP BY 1, 2), "
    "m AS (SELECT c, vec_id, row_number() OVER (PARTITION BY c ORDER BY total, vec_id) AS r FROM t) "
    'SELECT n.c AS "case", CASE WHEN n <= 2 THEN least ELSE vec_id END AS key FROM n JOIN m ON n.c = m.c AND r = 1'
)
def question_vote(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").withColumn("case", F.col("vec_id") % 180)
    return corpus.question_vote(e, "case", "vec_id", "embedding")


@query("SELECT concat('t', c_nationkey, '_', c_custkey % 30) AS stem, count(*) AS files FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    """Stems of file names that occur in several folders."""
    c = _read(spark, sf_dir, "customer")
    return corpus.repeated_names(c.select(F.format_string("db%d/t%d_%d.sql", "c_custkey", "c_nationkey", F.col("c_custkey") % 30).alias("path")), "path")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey % 2 END::DOUBLE AS acc_sql, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS acc_vec, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_nationkey % 2 + 0.5) / 2 END::DOUBLE AS acc FROM customer")
def judge_scores(spark, sf_dir):
    """Scores from a judge's answers; every third one holds none."""
    c = _read(spark, sf_dir, "customer").withColumn("answer", F.when(F.col("c_custkey") % 3 == 0, F.lit("can't tell")).otherwise(F.format_string('Scores: {"ACC_SQL": %d, "ACC_Vec": 0.5} as asked', F.col("c_nationkey") % 2)))
    return metrics.judged(c, "answer").select("c_custkey", "acc_sql", "acc_vec", "acc")


@query("SELECT c_custkey, concat('{\"c_name\":\"', c_name, '\",\"c_nationkey\":\"', c_nationkey, '\"}') AS row FROM customer")
def comparable_rows(spark, sf_dir):
    """Result rows as texts: the columns that both sides have, in the gold order, without the distance."""
    c = _read(spark, sf_dir, "customer").withColumn("distance", F.lit(0.5))
    return c.select("c_custkey", metrics.comparable(c, ["c_name", "distance", "c_nationkey", "elsewhere"], c.columns).alias("row"))


@query(
    _CASES + ", m AS (SELECT *, CASE query_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, CASE query_id % 3 WHEN 0 THEN 'x' ELSE 'y' END AS backend FROM z)"
    ", c AS (SELECT model, " + ", ".join(f"avg(CASE WHEN backend = '{b}' THEN {v} END) * 100 AS {b}_{v}" for b in "xy" for v in ("f1", "ndcg")) + " FROM m GROUP BY model) "
    "SELECT model, printf('%.4f / %.4f', x_f1, x_ndcg) AS x_d, printf('%.4f / %.4f', y_f1, y_ndcg) AS y_d, printf('%.4f / %.4f', (x_f1 + y_f1) / 2, (x_ndcg + y_ndcg) / 2) AS macro_average FROM c"
)
def percent_report(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("model", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b")).withColumn("backend", F.when(F.col("query_id") % 3 == 0, "x").otherwise("y")).withColumn("dataset", F.lit("d"))
    return metrics.percent_report(s, "f1", "ndcg", digits=4)


# ---- sources, schemas ----------------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS text FROM documents")
def sample_truncate(spark, sf_dir):
    return catalog.shortened(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT o_orderkey, o_totalprice AS price, CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CAST(NULL AS BIGINT) AS status FROM orders")
def coerce_values(spark, sf_dir):
    _, schema = schemas.from_ddl("CREATE TABLE t (o_orderkey INTEGER, price REAL, day DATE, status INT)")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"), F.col("o_orderstatus").alias("status"))
    return schemas.coerce(o, schema).withColumn("day", F.col("day").cast("string"))


_TIMES = (
    ("yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S.000"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%d %H:%M:%S.000"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M:00.000"),
    ("yyyy-MM-dd", "%Y-%m-%d 00:00:00.000"),
    ("dd/MM/yyyy", None),
    ("yyyy-MM-dd'T'HH:mm", None),
)


@query("SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN strftime(ts, '{back}')" for i, (_, back) in enumerate(_TIMES) if back) + " END AS at FROM events")
def coerce_times(spark, sf_dir):
    """Each written form of a time that is read, and two that are not."""
    _, schema = schemas.from_ddl("CREATE TABLE t (event_id INTEGER, at DATETIME)")
    written = None
    for i, (form, _) in enumerate(_TIMES):
        text = F.date_format("ts", form)
        written = F.when(F.col("event_id") % 8 == i, text) if written is None else written.when(F.col("event_id") % 8 == i, text)
    out = schemas.coerce(_read(spark, sf_dir, "events").select("event_id", written.alias("at")), schema)
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(length({c})), 4) AS avg_length, round(count(DISTINCT {c}) / count(*), 4) AS distinct_share, avg(length({c})) >= 20 AND count(DISTINCT {c}) / count(*) >= 0.3 AS is_rich FROM documents"
        for c in ("text", "lang", "source")
    )
)
def semantic_columns(spark, sf_dir):
    return catalog.semantic_columns(_read(spark, sf_dir, "documents"))


@query("SELECT c_name, id, ('0x' || substr(md5('42:ref:' || id), 1, 8))::BIGINT % 7 AS ref FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS id FROM customer)")
def assign_keys(spark, sf_dir):
    return schemas.assign_keys(_read(spark, sf_dir, "customer").select("c_name"), "c_name", "id", {"ref": 7})


@query(
    "SELECT table_name, ordinal_position - 1 AS position, column_name, data_type IN ('FLOAT[]', 'DOUBLE[]') AS is_vector FROM information_schema.columns WHERE table_name IN ("
    + ", ".join(f"'{t}'" for t in catalog.TABLES) + ")"
)
def describe_tables(spark, sf_dir):
    _tables(spark, sf_dir)
    return catalog.describe(spark, catalog.TABLES).select("table_name", "position", "column_name", "is_vector")


@query(" UNION ALL ".join(f"(SELECT '{c}' AS column_name, doc_id AS key, {c} AS value FROM documents WHERE {c} IS NOT NULL ORDER BY doc_id LIMIT 2)" for c in ("text", "source")))
def column_values(spark, sf_dir):
    return catalog.column_values(_read(spark, sf_dir, "documents"), ["text", "source"], "doc_id")


@query("SELECT o_orderkey AS query_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, o_totalprice AS price FROM orders")
def json_results(spark, sf_dir):
    """Results written as JSON lines and read back; times become texts."""
    path = _folder(spark)
    files.write_results(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price")), path)
    return files.read_json(spark, path, "query_id long, at string, price double", lines=True)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def cache_misses(spark, sf_dir):
    """Customers as cases, orders as cached results; one that is pending counts as failed."""
    o = _read(spark, sf_dir, "orders")
    cache = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "pending").alias("error"))
    return files.missing_from_cache(_read(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey")


@query("SELECT conv_id AS \"case\", string_agg(concat_ws(': ', role, coalesce(text, '')), chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id")
def dialogue(spark, sf_dir):
    return corpus.dialogue(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "SELECT n_nationkey, concat('About ', n_name, ': ', n_regionkey, '?') AS prompt, concat('img/', n_name) AS path, CASE WHEN contains(lower('SELECT N_NAME FROM t'), 'n_name') THEN 'n_name' END AS used, i AS loop "
    "FROM nation, range(1, 9) AS r(i) WHERE i <= greatest(1, 2 * n_regionkey)"
)
def prompt_fields(spark, sf_dir):
    """Prompts filled from columns, columns that a statement uses, prefixed paths, and a row for each statement to make."""
    n = corpus.synthesis_loops(_read(spark, sf_dir, "nation"), 2, "n_regionkey")
    n = corpus.prefixed(n.withColumn("path", F.col("n_name")), "path", "img/")
    used = corpus.used_columns(F.lit("SELECT N_NAME FROM t"), F.array(F.lit("n_name"), F.lit("n_comment")))
    return n.select("n_nationkey", corpus.fill("About {a}: {b}?", a="n_name", b="n_regionkey").alias("prompt"), "path", F.array_join(used, ",").alias("used"), "loop")


@query("SELECT * FROM (VALUES ('q1', 'n_name'), ('q2', 'n_name,r_name'), ('q3', '')) AS v(query_id, columns)")
def reference_columns(spark, sf_dir):
    """Columns that predictions are aligned to: those of the first gold statement that runs."""
    join = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
    cases = [
        {"query_id": "q1", "predicted_sql": "SELECT 1", "sql_candidate": ["SELECT n_name FROM nation", join]},
        {"query_id": "q2", "predicted_sql": None, "sql_candidate": ["SELECT nothing FROM nation", join]},
        {"query_id": "q3", "predicted_sql": "SELECT 1", "sql": "SELECT nothing FROM nation"},
    ]
    runs = VectorSession(spark, sf_dir, tables=("nation", "region")).run_cases(cases, _folder(spark))
    return metrics.reference_columns(runs).withColumn("columns", F.array_join("columns", ","))

_RUNS = " UNION ALL ".join(f"SELECT {i} AS run, '{t}' AS \"table\", '{status}' AS status, count(*) AS rows FROM {t}" for i, status in ((1, "written"), (2, "present")) for t in ("nation", "orders"))


def _two_runs(run: Callable[[], DataFrame]) -> DataFrame:
    """Reports of a job that runs, and runs again."""
    first, second = (run().withColumn("run", F.lit(i)) for i in (1, 2))
    return first.unionByName(second).select("run", "table", "status", "rows")


@query(_RUNS + " UNION ALL SELECT CAST(i AS INTEGER), 'nowhere', 'failed', NULL FROM range(1, 3) AS r(i)")
def migrate_tables(spark, sf_dir):
    """Tables copied to a folder; the second run finds those of the first, and a table that is missing fails alone."""
    out = _folder(spark)
    tables = {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "orders", "nowhere")}
    return _two_runs(lambda: migrate.migrate(spark, tables, [out]))


@query(_RUNS)
def vectorize_tables(spark, sf_dir):
    """Tables written with vector columns; the second run finds them there."""
    out = _folder(spark)
    tables = {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "orders")}
    return _two_runs(lambda: vectorize.vectorize_database(spark, tables, {"nation": ["n_name"]}, out, vectorize.HashEmbedder))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, NOT EXISTS (SELECT 1 FROM {t}) AS is_empty" for t in catalog.TABLES))
def discover_tables(spark, sf_dir):
    found = catalog.discover(spark, sf_dir)
    return spark.createDataFrame([(t, catalog.is_empty([spark.read.parquet(path)])) for t, path in found.items()], "table_name string, is_empty boolean")


@query(
    "SELECT table_name, concat('CREATE TABLE \"', table_name, '\" (' || chr(10) || '  ', string_agg('\"' || column_name || '\" ' || CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'BIGINT' WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 'DOUBLE PRECISION' "
    "WHEN data_type = 'VARCHAR' THEN 'TEXT' WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' WHEN data_type IN ('FLOAT[]', 'DOUBLE[]') THEN 'vector' ELSE data_type END, ',' || chr(10) || '  ' ORDER BY ordinal_position), chr(10) || ')') AS ddl "
    "FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in catalog.TABLES) + ") GROUP BY table_name"
)
def ddl_texts(spark, sf_dir):
    return migrate.schema_texts(spark, {t: _read(spark, sf_dir, t) for t in catalog.TABLES}, "postgresql")


@query(
    "WITH t AS (SELECT n_regionkey AS d, n_name AS t, n_nationkey AS k, n_nationkey % 5 > 1 AS good FROM nation) "
    "SELECT d AS db_id, t AS table_name, (SELECT count(*) FROM t b WHERE b.k = (a.k + 8) % 25 AND b.d = a.d AND b.good) AS keys FROM t a WHERE good"
)
def valid_tables(spark, sf_dir):
    """Tables with columns that don't repeat, and of their foreign keys those that lead to a column of the same database."""
    n = _read(spark, sf_dir, "nation")
    columns = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("id"), F.lit("id"))).when(F.col("n_nationkey") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("id"), F.lit("ref")))
    target = n.select(((F.col("n_nationkey") + 17) % 25).alias("k"), F.col("n_name").alias("ref_table"))
    key = lambda column: F.struct(F.lit("ref").alias("column"), F.col("ref_table"), F.lit(column).alias("ref_column"))
    described = n.join(target, F.col("k") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("db_id"), F.col("n_name").alias("table_name"), columns.alias("columns"), F.array(key("id"), key("missing")).alias("foreign_keys"))
    return schemas.valid_tables(described).select("db_id", "table_name", F.size("foreign_keys").cast("long").alias("keys"))


_TABLE = '{"table_name": "%s", "column_names": ["id", "ref"], "column_types": ["INT", "INT"], "column_descriptions": [%s]}'
_KEY = '{"source_table": "%s", "column_in_source_table": "ref", "referenced_table": "%s"%s}'
_GOOD, _OTHER, _UNEVEN = _TABLE % ("Orders", '"a", "b"'), _TABLE % ("parts", '"a", "b"'), _TABLE % ("odd", '"a"')
_TO = ', "column_in_referenced_table": "id"'
#: Schemas as texts: cut off, without keys, with an uneven table, with a key to no table, with a key that lacks a column, empty.
_TEXTS = (
    '{"tables": [',
    '{"tables": [%s]}' % _GOOD,
    '{"tables": [%s, %s], "foreign_keys": [%s, %s]}' % (_GOOD, _UNEVEN, _KEY % ("orders", "ORDERS", _TO), _KEY % ("orders", "odd", _TO)),
    '{"tables": [%s, %s], "foreign_keys": [%s]}' % (_GOOD, _OTHER, _KEY % ("orders", "gone", _TO)),
    '{"tables": [%s, %s], "foreign_keys": [%s, %s]}' % (_GOOD, _OTHER, _KEY % ("parts", "orders", _TO), _KEY % ("orders", "parts", "")),
    '{"tables": [], "foreign_keys": []}',
)


@query(
    "WITH d AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 50 = 8 THEN 'building__1__2' ELSE translate(lower(c_mktsegment || ' (' || c_nationkey % 3 || ')'), '()- *', '_____') END AS base FROM customer WHERE c_custkey % 6 > 1), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY key) AS i FROM d), s AS (SELECT *, CASE WHEN i > 1 THEN base || '_' || i ELSE base END AS id FROM n) "
    "SELECT key, CASE WHEN i > 1 AND id IN (SELECT base FROM d) THEN id || '_' || substr(md5(base || '/' || i), 1, 12) ELSE id END AS db_id, "
    "CASE key % 6 WHEN 2 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS tables, CASE WHEN key % 6 IN (2, 4) THEN 1 ELSE 0 END AS keys FROM s"
)
def schema_texts(spark, sf_dir):
    """Schemas written as JSON for every customer: what is kept of them, and ids of domains that are often equal."""
    c = _read(spark, sf_dir, "customer")
    domain = F.when(F.col("c_custkey") % 50 == 8, "Building (1)_2").otherwise(F.concat("c_mktsegment", F.lit(" ("), (F.col("c_nationkey") % 3).cast("string"), F.lit(")")))
    written = c.select("c_custkey", domain.alias("domain"), F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("text"))
    found = schemas.parsed_schemas(written, "text", "domain", "c_custkey")
    return found.select("key", "db_id", F.size("tables").alias("tables"), F.size("foreign_keys").alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS cust, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS price, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders")
def zero_nulls(spark, sf_dir):
    """Values of a dump for a server without nulls; what can't be read becomes the type's zero."""
    _, schema = schemas.from_ddl("CREATE TABLE t (o_orderkey INTEGER, cust INTEGER, price REAL, status TEXT)")
    third = F.col("o_orderkey") % 3 == 0
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(~third, F.col("o_custkey")).alias("cust"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("n/a")).alias("price"), F.when(~third, F.col("o_orderstatus")).alias("status"))
    return schemas.coerce(o, schema, zero_nulls=True)


@query("SELECT vec_id, label, vec_id + label AS both FROM embeddings")
def narrow_columns(spark, sf_dir):
    """Vectors go first where a table is too wide, then the columns at its end."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("text_embedding"), "label", (F.col("vec_id") + F.col("label")).alias("both"), F.lit(1).alias("last"))
    return schemas.narrow(e, 3)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sqlite_tables(spark, sf_dir):
    """A table as SQLite database images and back."""
    path = _folder(spark)
    sqlite.to_images(_read(spark, sf_dir, "customer"), "customer", rows=5000).write.parquet(path)
    return sqlite.read_images(spark.read.parquet(path), "customer", "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").drop("path").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total, label FROM embeddings")
def sqlite_vectors(spark, sf_dir):
    """Vectors at rest in SQLite as 32-bit floats."""
    images = sqlite.to_images(_read(spark, sf_dir, "embeddings"), "embeddings", rows=3000)
    rows = sqlite.read_images(images, "embeddings", "vec_id long, embedding array<float>, label long")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 5).alias("total"), F.col("label").cast("int").alias("label"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def dump_script(spark, sf_dir):
    """A table as a script of INSERT statements, whose texts hold line feeds and quotes, and back."""
    path = _folder(spark)
    dump.written(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conversations").write.text(path)
    return dump.rows_of(dump.statements(spark, path), "conversations", "conv_id long, turn long, role string, text string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_report(spark, sf_dir):
    """A report written as CSV and read back."""
    path = _folder(spark)
    files.write_csv(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path, header=True)



# ---- streaming forms, run as batches -------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    return jobs.hourly(_read(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"
)
def stream_sessions(spark, sf_dir):
    return jobs.sessions(_read(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


_DAYS = "SELECT event_type AS kind, date_trunc('day', ts) AS start, event_id AS key, abs(value - 50) AS distance, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY abs(value - 50), event_id) AS rank FROM events"


def _by_day(events: DataFrame) -> DataFrame:
    return state.nearest_by_window(events, "event_type", None, None, 3, "event_id", "ts", "1 day", "0 seconds", distance=F.abs(F.col("value") - 50))


def _days(found: DataFrame) -> DataFrame:
    return found.select(F.col("group").alias("kind"), F.col("start").cast("timestamp_ntz").alias("start"), "key", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT kind, start, key, round(distance, 6) AS distance, rank FROM ({_DAYS}) WHERE rank <= 3")
def nearest_by_day(spark, sf_dir):
    """Of each kind of event the three of every day nearest to 50."""
    return _days(_by_day(_read(spark, sf_dir, "events")))


@query(f"SELECT kind, start, key, round(distance, 6) AS distance, rank FROM ({_DAYS}) WHERE rank <= 3 AND start < (SELECT date_trunc('day', max(ts)) FROM events)")
def stream_nearest_by_day(spark, sf_dir):
    """The same by a stream with keyed state and timers, which gives the days that are over. It runs in a session of its own."""
    own, path = spark.newSession(), _folder(spark)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    state.use_rocksdb(own)
    events = own.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a single file by a pattern only
    writer = _by_day(events).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _days(spark.read.schema("group string, start timestamp, key long, distance double, rank int").parquet(f"{path}/rows"))


# ---- search as a table function ------------------------------------------------------------------------------------
@query(
    "SELECT e.vec_id, d.lang, round(list_distance(e.embedding, q.embedding), 6) AS distance FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 17) q WHERE e.vec_id IN (SELECT vec_id FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 17) WHERE label < 5 ORDER BY list_distance(embedding, q), vec_id LIMIT 10)"
)
def search_function_join(spark, sf_dir):
    """The ten nearest rows among some labels, by the table function; the cut comes before the join."""
    session = VectorSession(spark, sf_dir, tables=("embeddings", "documents"))
    return session.sql(
        "SELECT n.vec_id, d.lang, round(n.distance, 6) AS distance FROM (SELECT vec_id, distance FROM nearest(TABLE(SELECT vec_id, embedding FROM embeddings WHERE label < 5), 'embedding', "
        "(SELECT embedding FROM embeddings WHERE vec_id = 17), 10, 'vec_id') ORDER BY distance, vec_id LIMIT 10) n JOIN documents d ON d.doc_id = n.vec_id"
    )


@query("SELECT vec_id, label, round(1 - list_cosine_similarity(embedding, q), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 23) ORDER BY 1 - list_cosine_similarity(embedding, q), vec_id LIMIT 25")
def search_function_cosine(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    found = search_function.nearest_rows(rows, "embedding", _vector_of(spark, sf_dir, 23), 25, "vec_id", "cosine")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))
