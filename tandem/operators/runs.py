"""Sets of integers as runs (lo, hi), and all sums that one member of each set can give.

A run stands for all its integers, so a set costs what it has gaps and not what it has
members.  Sums of single runs are a run of sums, which is a plain partial aggregate;
only sets with gaps are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<lo: bigint, hi: bigint>>"


def _run(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def united(runs: Column) -> Column:
    """Runs in order, those that touch or overlap as one."""
    none = F.array().cast(RUNS)
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, r: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_run(last(acc)["lo"], F.greatest(last(acc)["hi"], r["hi"]))))
    return F.aggregate(F.array_sort(runs), none, lambda acc, r: F.when((F.size(acc) > 0) & (r["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"] + 1), grown(acc, r)).otherwise(F.concat(acc, F.array(_run(r["lo"], r["hi"])))))


def runs_of(numbers: Column) -> Column:
    """The runs of an array of integers; nulls do not count."""
    return united(F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x: _run(x, x)))


def added(a: Column, b: Column) -> Column:
    """The runs of all sums of a member of each."""
    return united(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _run(x["lo"] + y["lo"], x["hi"] + y["hi"])))))


def size(runs: Column) -> Column:
    """How many integers the runs hold."""
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["hi"] - r["lo"] + 1)


def career_sums(sets: DataFrame, by: list[str], runs: str, fan: int = 64) -> DataFrame:
    """(by, totals): the runs of all sums of one member from each of the group's sets.

    Single runs are summed by ends.  Sets with gaps are folded `fan` at a time, dealt by a
    hash of the set, then their results together, so no task folds all of a large group
    one by one.  An empty set, or a null one, is left out; a group of none has no row.
    """
    one = sets.where(F.size(runs) > 0)
    whole = F.size(runs) == 1
    ends = one.where(whole).groupBy(*by).agg(F.sum(F.get(runs, F.lit(0))["lo"]).alias("lo"), F.sum(F.get(runs, F.lit(0))["hi"]).alias("hi")).select(*by, F.array(_run(F.col("lo"), F.col("hi"))).alias("_runs"))
    fold = lambda df, keys: df.groupBy(*keys).agg(F.collect_list("_runs").alias("_sets")).select(*keys, F.aggregate("_sets", F.array(_run(F.lit(0), F.lit(0))), added).alias("_runs"))
    gaps = one.where(~whole).select(*by, F.col(runs).alias("_runs"))
    gaps = fold(gaps.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(fan))), [*by, "_part"]).drop("_part")
    return fold(ends.unionByName(gaps), by).withColumnRenamed("_runs", "totals")
