"""Hidden integers from rounded rates, and what career totals they leave possible.

A published rate own / (own + hidden), rounded to three decimals, leaves a range of
integers for the hidden count.  Sums over segments turn ranges into exact bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def displayed_rate(own: Column, hidden: Column) -> Column:
    """The rate in ten-thousandths after rounding half up to three decimals, in integers."""
    total = own + hidden
    return F.when(total > 0, F.floor((2000 * own + total) / (2 * total)).cast("long") * 10)


def hidden_counts(own: Column, rate: Column, cap: Column) -> Column:
    """All hidden counts that `rate` (ten-thousandths) allows, ascending, up to cap.

    Empty when own is not positive or the rate is not in (0, 1].
    """
    high, low = F.least(F.lit(10000), rate + 5), F.greatest(F.lit(0), rate - 5)
    least = F.ceil(own * 10000 / high) - own
    most = F.when(low <= 0, cap).otherwise(F.least(cap, F.floor(own * 10000 / F.nullif(low, F.lit(0))) - own))
    return F.when((own > 0) & (rate > 0) & (rate <= 10000) & (most >= least), F.sequence(least.cast("long"), most.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def exposure_cap(minutes: Column, floor: int = 25, extra: int = 30) -> Column:
    """The most hidden events that a stretch of minutes is taken to allow."""
    return F.greatest(F.lit(floor), F.ceil(minutes * 2.5 + extra)).cast("long")


def sums_of(a: Column, b: Column) -> Column:
    """All distinct sums of a candidate of each side, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x + y)))))


def career_bounds(segments: DataFrame, by: str, season: str = "season") -> DataFrame:
    """Per member: sums, least and most hidden total, rate bounds, and whether they meet.

    Segments without a candidate are left out, their exposure with them.
    """
    usable = segments.where(F.size("candidates") > 0)
    totals = usable.groupBy(by).agg(
        F.sum("exposure").alias("exposure"),
        F.sum("own").alias("own"),
        F.sum(F.array_min("candidates")).alias("hidden_min"),
        F.sum(F.array_max("candidates")).alias("hidden_max"),
        F.sum((F.size("candidates") > 1).cast("long")).alias("ambiguous"),
        F.count_distinct(season).alias("seasons"),
    )
    rate = lambda hidden: F.try_divide(100.0 * F.col("own"), F.nullif((F.col("own") + F.col(hidden)).cast("double"), F.lit(0.0)))
    out = totals.withColumns({"pct_min": rate("hidden_max"), "pct_max": rate("hidden_min"), "exact": F.col("hidden_min") == F.col("hidden_max")})
    return out.withColumn("pct_exact", F.when(F.col("exact"), F.col("pct_min")))


def career_exact(segments: DataFrame, by: str, least_exposure: float) -> DataFrame:
    """Members whose every segment is exact and whose exposure over all segments reaches the least."""
    totals = segments.groupBy(by).agg(
        F.sum("exposure").alias("exposure"),
        F.sum("own").alias("own"),
        F.sum(F.get("candidates", F.lit(0))).alias("hidden"),
        F.bool_and(F.size("candidates") == 1).alias("all_exact"),
    )
    kept = totals.where(F.col("all_exact") & (F.col("exposure") >= least_exposure)).drop("all_exact")
    return kept.withColumn("pct", F.try_divide(100.0 * F.col("own"), F.nullif((F.col("own") + F.col("hidden")).cast("double"), F.lit(0.0))))


def fallback_queue(segments: DataFrame, by: str, least_exposure: float, task: list[str]) -> DataFrame:
    """(task, n_open): tasks with a segment that is not exact, of a member whose exposure over all segments reaches the least."""
    qualified = segments.groupBy(by).agg(F.sum("exposure").alias("_sum")).where(F.col("_sum") >= least_exposure).select(by)
    open_ = segments.where(F.size("candidates") != 1).join(qualified, by, "left_semi")
    return open_.groupBy(*task).agg(F.count(F.lit(1)).alias("n_open"))
