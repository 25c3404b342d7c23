"""Aggregates over runs of an evaluation: rows of ``task, condition, passed, calls, ms, cost``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.avg("calls").alias("mean_calls"), F.avg("ms").alias("mean_ms"), F.sum("cost").alias("total_cost"))


def flag(before: Column, after: Column, tolerance: float = 0.05) -> Column:
    """worse, better or same by relative change; new or gone where one side is missing."""
    change = (after - before) / before
    return F.when(before.isNull(), "new").when(after.isNull(), "gone").when(change > tolerance, "worse").when(change < -tolerance, "better").otherwise("same")


def diff(before: DataFrame, after: DataFrame, keys: list[str], measure: str) -> DataFrame:
    b, a = (df.select(*keys, F.col(measure).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, keys, "full_outer").withColumn("flag", flag(F.col("before"), F.col("after")))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles that are values of the data, with mean and extremes."""
    at = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(q * 100)}") for q in shares]
    return rows.groupBy(key).agg(*at, F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def _as_words(text: Column, value: Column) -> Column:
    """Whether the value stands in the text with no word character on either side; its own marks are literal."""
    return F.contains(text, value) & F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), F.lit(r"\Q"), value, F.lit(r"\E"), F.lit(r"(?![A-Za-z0-9_])")))


def graded(answers: DataFrame) -> DataFrame:
    """``expected`` is ``struct(type, value, pattern, values)``; exact means contained, ``all`` asks for every value as whole words."""
    text, e = F.lower("answer"), F.col("expected")
    hit = F.when(e["type"] == "exact", F.contains(text, F.lower(e["value"]))).when(e["type"] == "regex", F.expr("answer RLIKE expected.pattern"))
    return answers.withColumn("passed", hit.when(e["type"] == "all", F.forall(e["values"], lambda v: _as_words(text, F.lower(v)))).otherwise(F.lit(False)))


def cost(input_tokens: Column, output_tokens: Column, per_input: float, per_output: float) -> Column:
    return (input_tokens * per_input + output_tokens * per_output) / 1_000_000


def latest_runs(runs: DataFrame, run_id: str, n: int = 2) -> DataFrame:
    """Rows of the last runs, newest as 1; ranks come from the distinct ids alone."""
    ids = runs.select(run_id).distinct().orderBy(F.desc(run_id)).limit(n)
    ranked = ids.withColumn("recency", F.row_number().over(Window.orderBy(F.desc(run_id))))
    return runs.join(F.broadcast(ranked), run_id)


def labels_by_condition(calls: DataFrame, conditions: list[str]) -> DataFrame:
    """A row for each label with its number of calls under each condition, and ``total``."""
    counted = calls.groupBy("label").pivot("condition", conditions).agg(F.count(F.lit(1))).fillna(0)
    return counted.withColumn("total", sum((F.col(c) for c in conditions), F.lit(0)).cast("long"))
