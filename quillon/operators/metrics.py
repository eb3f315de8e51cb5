"""Result-set metrics over tables of executions.

Predicted rows: (query_id, pos, row). Gold rows: (query_id, run_id, pos, row), where run_id
tells the accepted alternatives apart. ``row`` is the comparable text of a result row, made by
``comparable``. Cases: (query_id, ok), ok false where the prediction failed: it gets no
scores and counts 0 in averages. All metrics come from one set of joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comparable(df: DataFrame, columns: list[str], others: list[str]) -> Column:
    """A row as JSON of those of ``columns`` (the gold ones, in their order) that ``others`` has; distance doesn't count."""
    shared = [c for c in columns if c in others and c != "distance"]
    return F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")).alias(c) for c in shared]))


def distinct_in_order(rows: DataFrame) -> DataFrame:
    """First place of each distinct row of a query, and its rank among them from 1."""
    first = rows.groupBy("query_id", "row").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def evaluate(cases: DataFrame, predicted: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, exact_match, precision, recall, f1, map, mrr, ndcg), null where the prediction failed."""
    seen = distinct_in_order(predicted)
    truth = gold.groupBy("query_id", "row").agg(F.count("*").alias("gain"))
    met = seen.join(truth, ["query_id", "row"], "left").withColumn("hit", F.col("gain").isNotNull().cast("int"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("hits", F.sum("hit").over(upto))
    log2 = lambda c: F.log2(c + F.lit(1.0))
    per_test = met.groupBy("query_id").agg(
        F.count("*").alias("n_test"),
        F.sum("hit").alias("n_hit"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("precisions"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.col("gain") / log2(F.col("rank")))).alias("dcg"),
    )
    best = truth.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "row")))
    per_gold = best.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("place") <= k, F.col("gain") / log2(F.col("place")))).alias("idcg"))
    # exact: some alternative has all of the distinct predicted rows, and no others
    runs = gold.select("query_id", "run_id", "row").distinct()
    shared = runs.join(seen.select("query_id", "row").withColumn("both", F.lit(1)), ["query_id", "row"], "left")
    shared = shared.groupBy("query_id", "run_id").agg(F.count("*").alias("size"), F.coalesce(F.sum("both"), F.lit(0)).alias("both"))
    exact = shared.join(per_test.select("query_id", "n_test"), "query_id").filter("size = both AND both = n_test").select("query_id").distinct().withColumn("exact", F.lit(1.0))
    out = cases.join(per_test, "query_id", "left").join(per_gold, "query_id", "left").join(exact, "query_id", "left")
    out = out.fillna({"n_test": 0, "n_hit": 0, "n_gold": 0})
    no_test, no_gold = F.col("n_test") == 0, F.col("n_gold") == 0
    precision = F.when(no_test, 1.0).when(no_gold, 0.0).otherwise(F.col("n_hit") / F.greatest("n_test", F.lit(1)))
    recall = F.when(no_gold, 1.0).when(no_test, 0.0).otherwise(F.col("n_hit") / F.greatest("n_gold", F.lit(1)))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    ranked = lambda c: F.when(no_test & no_gold, 1.0).when(no_test | no_gold, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    scores = {
        "exact_match": F.when(no_test & no_gold, 1.0).otherwise(F.coalesce("exact", F.lit(0.0))),
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0),
        "map": ranked(F.col("precisions") / F.greatest("n_gold", F.lit(1))),
        "mrr": ranked(1 / F.col("first")),
        "ndcg": ranked(F.col("dcg") / F.col("idcg")),
    }
    return out.select("query_id", *[F.when(F.col("ok"), v).alias(name) for name, v in scores.items()])


SCORES = ("exact_match", "precision", "recall", "f1", "map", "mrr", "ndcg")


def summary(scores: DataFrame) -> DataFrame:
    """average_<score> over all cases, failures counting 0; count_<score>; totals. f1_score is f1 by its other name."""
    total = F.count("*")
    return scores.agg(
        *[(F.coalesce(F.sum(s), F.lit(0.0)) / total).alias(f"average_{s}") for s in SCORES],
        (F.coalesce(F.sum("f1"), F.lit(0.0)) / total).alias("average_f1_score"),
        *[F.count(s).alias(f"count_{s}") for s in SCORES],
        total.alias("total_cases"),
        F.count("f1").alias("successful_evaluations"),
        (F.count("f1") / total).alias("evaluation_success_rate"),
    )


def compare_models(scores: DataFrame, score: str = "f1") -> DataFrame:
    """scores: (model, backend, dataset, ...). A row per model, a column per backend and dataset, and the mean of cells present."""
    cells = scores.groupBy("model", F.concat_ws("_", "backend", "dataset").alias("cell")).agg((F.coalesce(F.sum(score), F.lit(0.0)) / F.count("*")).alias("v"))
    wide = cells.groupBy("model").pivot("cell").agg(F.first("v"))
    return wide.join(cells.groupBy("model").agg(F.avg("v").alias("macro_average")), "model")


def percent_report(scores: DataFrame, first: str, second: str, digits: int = 1) -> DataFrame:
    """scores: (model, backend, dataset, ...). Cells 'a / b': the means of two scores in percent, by backend and dataset, and those of all cells."""
    both = None
    for s in (first, second):
        wide = compare_models(scores, s)
        named = wide.select("model", *[F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{digits}f", F.col(f"`{c}`") * 100)).alias(f"{s}|{c}") for c in wide.columns if c != "model"])
        both = named if both is None else both.join(named, "model")
    cells = [c.split("|", 1)[1] for c in both.columns if c.startswith(f"{first}|")]
    cell = lambda c: F.concat(F.coalesce(F.col(f"`{first}|{c}`"), F.lit("-")), F.lit(" / "), F.coalesce(F.col(f"`{second}|{c}`"), F.lit("-")))
    return both.select("model", *[cell(c).alias(c) for c in cells])


def reference_columns(runs: DataFrame) -> DataFrame:
    """(query_id, columns): those of the first gold run of each case that succeeded and has any; none where no run did."""
    gold = runs.filter(F.col("run_id") >= 0)
    good = F.when((F.col("status") == "success") & (F.size("columns") > 0), F.struct("run_id", "columns"))
    return gold.groupBy("query_id").agg(F.coalesce(F.min(good)["columns"], F.array().cast("array<string>")).alias("columns"))


def judged(df: DataFrame, answer_col: str) -> DataFrame:
    """Adds acc_sql, acc_vec and acc from a judge's answer, a JSON object somewhere in a text; 0 where there is none."""
    found = F.from_json(F.regexp_extract(answer_col, r"(?s)\{.*\}", 0), "ACC_SQL double, ACC_Vec double")
    out = df.withColumn("acc_sql", F.coalesce(found["ACC_SQL"], F.lit(0.0))).withColumn("acc_vec", F.coalesce(found["ACC_Vec"], F.lit(0.0)))
    return out.withColumn("acc", (F.col("acc_sql") + F.col("acc_vec")) / 2)
