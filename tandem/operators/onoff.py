"""With / without splits, long and wide metric tables, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_off(on: DataFrame, totals: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For each member's `on` sums, the rest of the totals of the same keys as `off`."""
    whole = totals.select(*keys, *[F.col(f).alias(f"all_{f}") for f in fields])
    joined = on.join(whole, keys)
    return joined.select(*[c for c in on.columns if c not in fields], *[F.col(f).alias(f"on_{f}") for f in fields], *[(F.col(f"all_{f}") - F.col(f)).alias(f"off_{f}") for f in fields])


def to_long(wide: DataFrame, keys: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, metric, on, off, on_off) from pairs of columns."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("on"), F.col(b).cast("double").alias("off")) for m, (a, b) in metrics.items()])
    rows = wide.select(*keys, F.explode(parts).alias("m"))
    return rows.select(*keys, "m.metric", "m.on", "m.off", (F.col("m.on") - F.col("m.off")).alias("on_off"))


def to_wide(long: DataFrame, keys: list[str], metrics: list[str], value: str, order: str) -> DataFrame:
    """One column per metric: its first non-null value by order."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return long.groupBy(*keys).pivot("metric", metrics).agg(first)


def weighted_mean(value: Column, weight: Column, pairwise: bool = False) -> Column:
    """Sum of w * v over the sum of w, null at no weight; pairwise leaves out rows where either is null."""
    w = F.when(value.isNotNull(), weight) if pairwise else weight
    return F.try_divide(F.sum(weight * value), F.nullif(F.sum(w), F.lit(0.0)))


def ratio_of_sums(part: Column, rate: Column) -> Column:
    """Sum of parts over the sum of opportunities that the rates imply."""
    return F.try_divide(F.sum(part), F.nullif(F.sum(F.try_divide(part, F.nullif(rate, F.lit(0.0)))), F.lit(0.0)))


def summary_else_sum(is_summary: Column, value: Column) -> Column:
    """The summary row's value where there is one, else the sum of the parts."""
    return F.coalesce(F.max(F.when(is_summary, value)), F.sum(F.when(~is_summary, value)))


def ambiguous_free_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value for keys that stand for one value only; the others are left out."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")


def dedup_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: its rows, and how many of them differ; identical repeats are harmless, differing ones a conflict."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.struct(*rest)).alias("versions"))


def cross_rates(points: str, possessions: str, off: str, deff: str, other: str = "opp_") -> dict[str, Column]:
    """Rates of a team by name, those of the other side from the columns with the prefix.

    A team's offensive rebounds are out of its own and the other's defensive ones, its
    defensive ones out of its own and the other's offensive ones; null where a part is
    missing or the whole is 0.
    """
    c = F.col
    rate = lambda part, whole: F.try_divide(part.cast("double") * 100.0, F.nullif(whole.cast("double"), F.lit(0.0)))
    attack, defence = rate(c(points), c(possessions)), rate(c(other + points), c(other + possessions))
    mine, theirs = c(off) + c(deff), c(other + off) + c(other + deff)
    return {
        "offensive_rating": attack, "defensive_rating": defence, "net_rating": attack - defence, "off_rebound_pct": rate(c(off), c(off) + c(other + deff)),
        "def_rebound_pct": rate(c(deff), c(deff) + c(other + off)), "total_rebound_pct": rate(mine, mine + theirs),
    }
