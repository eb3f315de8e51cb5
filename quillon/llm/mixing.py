"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words. Its weight over training time t in
[0, 1] follows a piecewise-linear schedule; the schedule's integral is the
source's cumulative demand, and inverting it turns a document's offset in its
source's word stream into its training position. Documents are range-sorted by
position. A source whose target exceeds its size is read in several passes.

Defined results: null text has size 0; null is a source of its own, last in
order; a source of size 0 gets target 0; an empty table gives an empty mix.
Order within a source is by a seeded hash of id, size and text, so reruns agree;
rows that tie in all of these are alike, and either may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, split_of, splits

WORD = r"[^\x20\x09-\x0D]+"
#: Relative weight at equally spaced times, dealt to the sources in turn: rising, flat, falling.
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def _inverse_demand(u: Column, schedule: tuple[float, ...]) -> Column:
    """Time at which the share u of the schedule's integral is reached."""
    n = len(schedule) - 1
    areas = [(a + b) / (2 * n) for a, b in zip(schedule, schedule[1:])]
    total, before, out = sum(areas), 0.0, None
    for k, (a, b) in enumerate(zip(schedule, schedule[1:])):
        # within the segment, demand is a*x + (b-a)*n/2 * x^2 for x = t - k/n
        need, slope = u * F.lit(total) - F.lit(before), (b - a) * n
        x = need / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + need * F.lit(2 * slope), F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        t = F.lit(k / n) + F.greatest(F.lit(0.0), F.least(x, F.lit(1 / n)))
        before += areas[k]
        last = k == n - 1
        out = (F.when(u * F.lit(total) <= F.lit(before), t) if out is None else out.when(u * F.lit(total) <= F.lit(before), t)) if not last else (t if out is None else out.otherwise(t))
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds rank and target.

    The shares are filled like water: with sources in order of cap / weight, those
    whose cap lies below the level that the rest would get are capped, and the level
    of the others follows from what remains. A row per source is all this sees.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    upto, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(every)).withColumn("all_weight", F.sum("weight").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("capped", F.col("ratio") <= level)
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    left = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - used) * F.col("weight") / F.nullif(left, F.lit(0.0))))
    return s.select("source", "source_size", "rank", "target")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("h"),
    ]


def _plan(rows: DataFrame, weights, schedules, max_epochs: int, cut: bool) -> DataFrame:
    """rows: a written table (id, source, size, h), and rid where rows are to be found again."""
    n = splits(rows.count())
    rows = rows.withColumn("split", split_of(n, F.col("h")))
    # a source's stream runs through its splits in turn, and within each by hash
    parts = rows.groupBy("source", "split").agg(F.sum("size").alias("words"))
    per_source = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs)
    parts = parts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = parts.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("split")) - F.col("words"))
    parts = parts.select(F.col("source").alias("s"), F.col("split").alias("p"), "source_size", "rank", "target", "before")
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("split") == F.col("p")))
    within = Window.partitionBy("source", "split").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(max_epochs), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))))
    rows = rows.withColumn("passes", passes.cast("int"))
    rest = F.when(F.col("passes") == max_epochs, 0).otherwise(F.round(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long")
    in_part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    whole = F.when(F.col("start") * 2 + F.col("size") <= rest * 2, F.col("size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", in_part if cut else whole)
    epochs = F.concat(F.array_repeat("size", F.col("passes")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(F.array().cast("array<bigint>")))

    def position(words: Column, k: Column) -> Column:
        u = (k * F.col("source_size") + F.col("start") + words / 2) / F.col("target")
        out = None
        for i, schedule in enumerate(schedules):
            t = _inverse_demand(u, schedule)
            out = F.when(F.col("rank") % len(schedules) == i, t) if out is None else out.when(F.col("rank") % len(schedules) == i, t)
        return out

    rows = rows.withColumn("positions", F.transform("epochs", position))
    taken = F.col("size") * F.when(F.col("size") > 0, F.col("passes")).otherwise(0) + F.when(F.col("size") > 0, F.col("part")).otherwise(0)
    out = rows.select("id", "size", "source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "epochs", "positions", "h", *[c for c in rows.columns if c == "rid"])
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_epochs: int = 3,
    cut: bool = True,
    seed: str = "mix",
) -> DataFrame:
    """One row per document, range-sorted by its first training position.

    Columns: id, size, source, source_size, target, taken, epochs (array of the
    words taken in each pass) and positions (training time of each of those passes). With cut, the document at the end of the
    last pass is taken in part; without, it is taken whole if at least half of it fits.
    Documents that the mix leaves out have no position and come last.
    """
    rows = materialise(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-rows")
    out = _plan(rows, weights, schedules, max_epochs, cut)
    # left-out documents are spread over (1, 2], so that no range holds them all
    key = F.coalesce(F.get("positions", F.lit(0)), F.lit(1.5) + F.col("h") / F.lit(2.0**64))
    return out.withColumn("__key", key).repartitionByRange("__key").sortWithinPartitions("__key").drop("__key", "h")


def sample_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it (whole documents), in order of training position.

    Rows are numbered as they are written; the plan is made without texts, which then move
    once to meet it and once to their range.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = materialise(docs.select(*own, *_sized(docs, id_col, text_col, source_col, seed), F.monotonically_increasing_id().alias("rid")), "mix-rows")
    plan = _plan(rows.select("rid", "id", "source", "size", "h"), weights, schedules, max_epochs, cut=False)
    plan = plan.filter(F.size("positions") > 0).select("rid", F.explode("positions").alias("at"))
    each = rows.select("rid", *[f"c{i}" for i in range(len(own))]).join(plan, "rid")
    each = each.repartitionByRange("at").sortWithinPartitions("at")
    return each.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
