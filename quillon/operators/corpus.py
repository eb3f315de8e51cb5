"""Processing of statement and question corpora: extraction, filters, votes, sampling and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import medoids
from .ranks import numbered


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_code_block(text: Column) -> Column:
    """Content of the last fenced SQL block, null if there is none."""
    return _strip(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```sql\s*(.*?)\s*```"), F.lit(1)), F.lit(-1)))


def dialogue(turns: DataFrame, case: str, order: str, role: str, text: str) -> DataFrame:
    """(case, dialogue): the turns of a case in order, each as 'role: text' on a line of its own."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat_ws(": ", role, F.coalesce(text, F.lit(""))).alias("line")))), lambda t: t["line"])
    return turns.groupBy(F.col(case).alias("case")).agg(F.array_join(lines, "\n").alias("dialogue"))


def last_section(text: Column, name: str) -> Column:
    """Content of the last [NAME-START] ... [NAME-END] section."""
    return _strip(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)\[{name}-START\](.*?)\[{name}-END\]"), F.lit(1)), F.lit(-1)))


def json_answer(text: Column, key: str = "sql") -> Column:
    """A field of the JSON object in an answer: in a fence, bare, or as a quoted pair; else a fenced block; else the text itself if it is a query."""
    field = lambda pattern, g: F.get_json_object(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")), f"$.{key}")
    quoted = F.nullif(F.regexp_extract(text, rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return F.coalesce(field(r"(?s)```json\s*(\{.*?\})\s*```", 1), field(r"(?s)(\{.*\})", 1), quoted, last_code_block(text), F.when(is_query(text), _strip(text)))


def strip_comments(sql: Column) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", ""))


def is_query(sql: Column) -> Column:
    return strip_comments(sql).rlike(r"(?i)^(select|with)\b")


#: Classes of tokens: white space, quoted texts with doubled quotes, words and numbers with their sign or exponent, anything else.
TOKEN_CLASSES = (r"\s+", "'[^']*+(?:''[^']*+)*+'", '"[^"]*+(?:""[^"]*+)*+"', r"-?[\w.]+(?:(?<=[\d.]e)[-+]\d+)?", r"(?s:.)")
#: Words that are literals.
LITERAL_WORDS = ("null", "true", "false")
MASK = "<v>"


def template(sql: Column) -> Column:
    """A lower-cased statement, token by token: literals masked, white space as one space."""

    def written(token: Column) -> Column:
        number = token.rlike(r"[\d.]$") & token.try_cast("double").isNotNull()
        return F.when(F.trim(F.translate(token, "\n\r\t\f\x0b", "     ")) == "", " ").when(F.left(token, F.lit(1)).isin("'", '"') & (F.length(token) > 1) | number | token.isin(*LITERAL_WORDS), MASK).otherwise(token)

    tokens = F.regexp_extract_all(F.lower(sql), F.lit("|".join(TOKEN_CLASSES)), F.lit(0))
    return F.trim(F.array_join(F.transform(tokens, written), ""))


def dedup_by_template(df: DataFrame, sql_col: str, order: str) -> DataFrame:
    """The first row, by order, of each template. Copies fold in before the shuffle, so a hot template is no hot task."""
    rows = df.select(F.md5(template(F.col(sql_col))).alias("__t"), F.col(order).alias("__o"))
    first = rows.groupBy("__t").agg(F.min("__o").alias("__o"))
    keyed = df.withColumn("__t", F.md5(template(F.col(sql_col))))
    return keyed.join(first, (keyed["__t"] == first["__t"]) & (keyed[order] == first["__o"]), "left_semi").dropDuplicates(["__t"]).drop("__t")


def column_count_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("column_count").agg(F.count("*").alias("statements"))


def majority_vote(results: DataFrame, case: str, response: str, row: str, least: int = 3) -> DataFrame:
    """results: a line per result row of each response. (case, response, votes) of the least response of the largest group; of groups alike in size, that with the least response.

    Responses agree if their sets of rows do; the set is folded to an order-free digest
    (count, sum and xor of row hashes), so no result is gathered. Cases with fewer than ``least`` responses go.
    """
    rows = results.select(F.col(case).alias("case"), F.col(response).alias("response"), F.xxhash64(row).alias("h"), F.hash(row).alias("g")).distinct()
    key = rows.groupBy("case", "response").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("g").cast("long")).alias("s"))
    votes = key.groupBy("case", "n", "x", "s").agg(F.count("*").alias("votes"), F.min("response").alias("response"))
    total = votes.groupBy("case").agg(F.sum("votes").alias("valid"), F.min(F.struct((-F.col("votes")).alias("fewer"), "response")).alias("w"))
    return total.filter(F.col("valid") >= least).select("case", "w.response", (-F.col("w.fewer")).alias("votes"))


def question_vote(df: DataFrame, case: str, key: str, vec_col: str) -> DataFrame:
    """(case, key): the only question of a case, the lesser of two, or the cosine medoid of three and more."""
    counts = df.groupBy(F.col(case).alias("case")).agg(F.count("*").alias("n"), F.min(key).alias("least"))
    best = medoids(df, case, key, vec_col).select(F.col("group").alias("case"), F.col("key").alias("medoid"))
    return counts.join(best, "case", "left").select("case", F.when(F.col("n") <= 2, F.col("least")).otherwise(F.col("medoid")).alias("key"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, uniform and the same on every run: those of least hash."""
    return df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def mix_ratio(small: DataFrame, large: DataFrame, r_small: int, r_large: int, key: str, seed: int = 42) -> DataFrame:
    """r_small : r_large, with all of small as the base; sizes never exceed what there is."""
    base, most = small.count(), large.count()
    n_small, n_large = (0, base) if r_small == 0 and r_large else (base, 0) if r_large == 0 and r_small else (base, base * r_large // r_small) if r_small else (0, 0)
    return sample_rows(small, min(n_small, base), key, seed).unionByName(sample_rows(large, min(n_large, most), key, seed + 1))


def _digits(n: int, seed: int, *key: str) -> Column:
    """The first n hexadecimal digits of the MD5 of seed and key, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])), 1, n), 16, 10).cast("long")


def pick(options: list[str], *key: str, seed: int = 42) -> Column:
    """One of the options, uniform by the hash of a row's key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (_digits(8, seed, *key) % len(options) + 1).cast("int"))


def uniform(*key: str, seed: int = 42) -> Column:
    """A number in (0, 1) from the hash of a row's key."""
    return (_digits(13, seed, *key) + 0.5) / float(16**13)


def geometric(p: float, *key: str, seed: int = 42) -> Column:
    return F.ceil(F.ln(1 - uniform(*key, seed=seed)) / F.ln(F.lit(1 - p))).cast("int")


def table_count(mean: float, deviation: float, least: int, most: int, *key: str, seed: int = 42) -> Column:
    """Normal, by Box and Muller, rounded and clipped."""
    z = F.sqrt(-2 * F.ln(uniform(*key, seed=seed))) * F.cos(2 * F.pi() * uniform(*key, seed=seed + 1))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.round(z * deviation + mean).cast("int")))


def synthesis_loops(df: DataFrame, per_column: int, rich_columns: str) -> DataFrame:
    """A row per statement to synthesise: max(1, per_column * rich columns) of them."""
    return df.withColumn("loop", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(per_column) * F.col(rich_columns)).cast("int"))))


def used_columns(sql: Column, names: Column) -> Column:
    """Those of an array of names that occur in a statement."""
    return F.filter(names, lambda n: F.contains(F.lower(sql), F.lower(n)))


def fill(form: str, **fields: str) -> Column:
    """A prompt: {name} in form stands for the text of that column."""
    out = F.lit(form)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return out


def succeeded(df: DataFrame) -> DataFrame:
    return df.filter("execution_status = 'success'") if "execution_status" in df.columns else df


def with_query_ids(df: DataFrame, order: str) -> DataFrame:
    """query_id q1, q2, ... by order."""
    return numbered(df, order, "query_id").withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))


def hashed_query_id(db: str, question: str) -> Column:
    return F.substring(F.md5(F.concat_ws("_", db, question)), 1, 16)


def ground_truth(df: DataFrame) -> DataFrame:
    """(query_id, db_name, sqls): the statement followed by its accepted alternatives."""
    return df.select("query_id", F.col("db_id").alias("db_name"), F.concat(F.array("sql"), F.coalesce("sql_candidate", F.array().cast("array<string>"))).alias("sqls"))


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def repeated_names(df: DataFrame, path_col: str) -> DataFrame:
    """(stem, files): file stems that occur more than once."""
    stem = F.regexp_extract(path_col, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.groupBy(stem.alias("stem")).agg(F.count("*").alias("files")).filter("files > 1")
