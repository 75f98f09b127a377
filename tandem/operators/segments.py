"""Segments with their errors stated, metric sets that must be complete, and several orders of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import intervals


def derive(rows: DataFrame, own: Column, rate: Column, cap: Column) -> DataFrame:
    """rows with own, candidates, exact and error: a row that cannot be derived stays, with the reason.

    Reasons in this order: a metric is missing, the count is no integer, no count fits the rate.
    """
    count = S.lenient_long(own)
    found = rows.withColumns({"own": count, "rate": rate, "_shown": S.lenient_double(own)}).withColumn("candidates", intervals.hidden_counts(F.col("own"), F.col("rate"), cap))
    error = F.when(F.col("_shown").isNull() | F.col("rate").isNull(), "missing metric").when(F.col("own").isNull(), "count is no integer").when(F.size("candidates") == 0, "no count fits")
    return found.withColumns({"error": error, "exact": error.isNull() & (F.size("candidates") == 1)}).drop("_shown")


def task_states(segments: DataFrame, by: str) -> DataFrame:
    """A task is complete if none of its segments has an error."""
    return segments.groupBy(by).agg(F.count(F.lit(1)).alias("segments"), F.count("error").alias("errors"), F.bool_and(F.col("error").isNull()).alias("complete"))


def metric_set(long: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    """One column per metric and whether all of them are there, in one aggregation."""
    rows = long.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m in metrics])
    complete = F.lit(True)
    for m in metrics:
        complete = complete & F.col(m).isNotNull()
    return rows.withColumn("complete", complete)


def wide(long: DataFrame, keys: list[str], metrics: list[str], values: list[str], order: Column) -> DataFrame:
    """A column `metric__value` for each metric and value: one aggregation, the first that is not null by `order`, a null order last."""
    place = F.struct(order.isNull().alias("late"), order.alias("at"))
    at = lambda m, v: F.when((F.col("metric") == m) & F.col(v).isNotNull(), place)
    return long.groupBy(*keys).agg(*[F.min_by(v, at(m, v)).alias(f"{m}__{v}") for m in metrics for v in values])


def verbatim_mean(value: Column, weight: Column) -> Column:
    """Sum of w * v over the sum of all w: a row without value keeps its weight."""
    return F.try_divide(F.sum(weight * value), F.nullif(F.sum(weight), F.lit(0.0)))


def with_exposure(rows: DataFrame, id_col: str, name: str, seconds: str) -> DataFrame:
    """Rows with an identifier, a name and a positive exposure."""
    return rows.where((S.clean_id(F.col(id_col)) != "") & (F.trim(name) != "") & (S.lenient_double(F.col(seconds)) > 0))


def metric_map(profiles: DataFrame, key: str, stat: str, fields: list[str]) -> DataFrame:
    """Profiles (one row per key and stat) turned into rows by metric; a blank stat goes."""
    named = profiles.where(F.trim(F.col(stat)) != "")
    return named.select(F.trim(F.col(stat)).alias("metric"), key, *fields)


def ordered_ids(value: Column, when: Column) -> Column:
    """The values of rows that meet a condition, distinct and in order, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(F.when(when, value.cast("string")))), ",")


def last_of(array: Column, n: int) -> Column:
    return F.when(F.size(array) > n, F.slice(array, -n, n)).otherwise(array)
