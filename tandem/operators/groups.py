"""Groups of members: additive totals, explosion into members, and the identities they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def additive_totals(rows: DataFrame, keys: list[str], fields: list[str], label: str | None = None, order: str | None = None) -> DataFrame:
    """Sums of the fields by key; the label is that of the row with the least order."""
    aggs: list[Column] = [F.sum(f).alias(f) for f in fields]
    if label and order:
        aggs.append(F.min_by(label, order).alias(label))
    return rows.groupBy(*keys).agg(*aggs)


def member_rows(groups: DataFrame, ids: str, size: int | None = None, names: str | None = None) -> DataFrame:
    """One row per member of an array of ids (with the matching name); groups of another size than `size` are an error of the data and go."""
    rows = groups if size is None else groups.where(F.size(ids) == size)
    if names is None:
        return rows.withColumn("member", F.explode(ids))
    rows = rows.where(F.size(ids) == F.size(names)).withColumn("_m", F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(names).alias("n"))))
    return rows.withColumns({"member": F.col("_m.i"), "member_name": F.col("_m.n")}).drop("_m")


def split_entity(entity: Column, sep: str = "-") -> Column:
    """`1-2-3` to a trimmed array."""
    return F.transform(F.split(entity, sep), lambda x: F.trim(x))


def weighted_mode(rows: DataFrame, key: str, label: str, weight: str) -> DataFrame:
    """The label with the greatest summed weight of each key; at equal weight the least label."""
    sums = rows.groupBy(key, label).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias(label), F.max("w").alias("weight"))


def pair_rows(rows: DataFrame, group: str, member: str, fields: list[str]) -> DataFrame:
    """Each ordered pair of different members of a group; groups are small (a lineup), so pairs are linear in rows."""
    other = rows.select(F.col(group), F.col(member).alias("mate"), *[F.col(f).alias(f"mate_{f}") for f in fields])
    return rows.select(group, F.col(member).alias("focal"), *fields).join(other, group).where("focal <> mate")
