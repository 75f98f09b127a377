"""Data-quality gates: each gives rows of (check_name, n_bad, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, name: str, bad: Column) -> DataFrame:
    """Rows for which `bad` holds."""
    return rows.agg(F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("passed"))


def unique(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows of keys that stand more than once, every one of them counted."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("passed"))


def same_keys(left: DataFrame, right: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return gate(a.join(b, keys, "full_outer"), name, F.col("_l").isNull() | F.col("_r").isNull())


def control_totals(actual: DataFrame, control: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(keys, field, observed, expected) where a field differs from its control total by more than the tolerance."""
    long = lambda df, value: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(value)) for f in fields])).alias("x")).select(*keys, "x.field", f"x.{value}")
    both = long(actual, "observed").join(long(control, "expected"), [*keys, "field"], "full_outer")
    return both.where(F.coalesce(F.abs(F.col("observed") - F.col("expected")) > tolerance, F.lit(True)))


def common_fields(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-7) -> DataFrame:
    """(key, field, same) for the numeric fields that both sides have."""
    numbers = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    shared = [c for c, t in left.dtypes if c != key and t in numbers and dict(right.dtypes).get(c) in numbers]
    long = lambda df, v: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(v)) for f in shared])).alias("x")).select(key, "x.*")
    return long(left, "a").join(long(right, "b"), [key, "field"]).select(key, "field", (F.abs(F.col("a") - F.col("b")) <= tolerance).alias("same"))


def exactly_one(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), F.abs(F.col("n") - 1).alias("n_bad"), (F.col("n") == 1).alias("passed"))


def row_count(rows: DataFrame, name: str, wanted: int) -> DataFrame:
    """How many rows there are too many or too few."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), F.abs(F.col("n") - wanted).alias("n_bad"), (F.col("n") == wanted).alias("passed"))


def same_count(left: DataFrame, right: DataFrame, name: str, n: str) -> DataFrame:
    """By how much two single-row tables differ in a count."""
    both = left.select(F.col(n).alias("a")).crossJoin(right.select(F.col(n).alias("b")))  # two single rows
    return both.select(F.lit(name).alias("check_name"), F.abs(F.col("a") - F.col("b")).cast("long").alias("n_bad"), (F.col("a") == F.col("b")).alias("passed"))


def pair_gate(own: DataFrame, other: DataFrame, window: list[str], id_col: str, names: str, exposure: str, cap: int = 500, members: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """(window, n_own, n_other, fault) of two answers to one question; fault is null where they may be used together.

    Faults in this order: `row cap` (an answer of cap rows was cut off), `one-sided`,
    `duplicate id`, `ids differ`, `not a group` (an id of other than `members` parts at
    `-`), `names do not parse` (the own side's, at commas), `exposure differs` by more
    than the tolerance.  Both sides are summed by id and then by window, so no rows are
    joined.  A null id is an id of its own, and no group.
    """
    side = lambda df, n: df.select(*window, F.col(id_col).alias("_id"), F.lit(n).alias("_own"), F.col(names).alias("_names"), F.col(exposure).cast("double").alias("_x"))
    mine = F.col("_own") == 1
    one = side(own, 1).unionByName(side(other, 0)).groupBy(*window, "_id").agg(
        F.count_if(mine).alias("_n"), F.count_if(~mine).alias("_m"), F.max(F.when(mine, F.col("_x"))).alias("_a"), F.max(F.when(~mine, F.col("_x"))).alias("_b"),
        F.bool_or(mine & (F.size(F.split(F.coalesce("_names", F.lit("")), ",")) != members)).alias("_lost"),
    )
    whole = one.groupBy(*window).agg(
        F.sum("_n").alias("n_own"), F.sum("_m").alias("n_other"), F.max(F.greatest("_n", "_m")).alias("_most"), F.bool_or((F.col("_n") == 0) | (F.col("_m") == 0)).alias("_differ"),
        F.bool_or(F.size(F.split(F.coalesce("_id", F.lit("")), "-")) != members).alias("_group"), F.bool_or("_lost").alias("_lost"), F.bool_or(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > tolerance, F.lit(False))).alias("_apart"),
    )
    fault = F.when((F.col("n_own") >= cap) | (F.col("n_other") >= cap), "row cap").when((F.col("n_own") == 0) | (F.col("n_other") == 0), "one-sided").when(F.col("_most") > 1, "duplicate id")
    fault = fault.when(F.col("_differ"), "ids differ").when(F.col("_group"), "not a group").when(F.col("_lost"), "names do not parse").when(F.col("_apart"), "exposure differs")
    return whole.select(*window, "n_own", "n_other", fault.alias("fault"))


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def enforce(checks: DataFrame) -> None:
    """Raises if any check failed; the report has a row per check, so it fits the driver."""
    bad = [f"{r['check_name']}: {r['n_bad']}" for r in checks.where(~F.col("passed")).collect()]
    if bad:
        raise ValueError("failed checks: " + "; ".join(bad))
