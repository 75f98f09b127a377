"""Row numbers and places of a whole table without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.scratch import kept

#: Of a row's number within a run, the bits that count rows; the others are its partition.
_ROWS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame], DataFrame] = kept, parts: int | None = None) -> DataFrame:
    """rows with their place from 0 in `order` in a column `name`, in two passes.

    The first deals rows into ranges of the order, sorts each and writes it with the
    place within the range; the second adds the number of rows of the ranges before,
    one count for each partition.  `keep` writes the first pass; both passes must see
    the same ranges.  Rows that are equal in `order` share a range and their places are
    arbitrary, so end the order with a unique key.  An empty table stays empty; the
    column `name` replaces one that is there.
    """
    rows = rows.drop(name)
    columns = list(rows.columns)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = keep(dealt.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _ROWS)
    sizes = first.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before - (r["part"] << _ROWS)))
        before += r["n"]
    if not offsets:
        return first
    if len(offsets) == 1:
        return first.withColumn(name, F.col(name) + F.lit(offsets[0][1]))
    table = rows.sparkSession.createDataFrame(offsets, "`_part` int, `_offset` long")  # one row for each partition
    return first.withColumn("_part", part.cast("int")).join(F.broadcast(table), "_part").withColumn(name, F.col(name) + F.col("_offset")).select(*columns, name)


def places(table: DataFrame, orders: dict[str, list[Column]]) -> DataFrame:
    """The table's place from 1 under each order, without ties."""
    for name, order in orders.items():
        table = numbered(table, order, name).withColumn(name, (F.col(name) + 1).cast("int"))
    return table


def rank_qualified(table: DataFrame, qualified: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Places from 1 over the qualified rows; the others (a null condition too) have none."""
    holds = F.coalesce(qualified, F.lit(False))
    out = numbered(table.withColumn("_holds", holds), [F.desc("_holds"), *order], name)
    return out.withColumn(name, F.when(F.col("_holds"), F.col(name) + 1).cast("int")).drop("_holds")
