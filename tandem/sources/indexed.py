"""Tables laid out for lookups and joins: buckets and order by key, Bloom filters for other columns, ordered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_indexed(df: DataFrame, name: str, key: str, buckets: int, lookups: dict[str, int] | None = None) -> None:
    """A managed Parquet table in `buckets` buckets by key, sorted by it inside each.

    Two such tables with equal buckets join on the key without an exchange.  `lookups`
    names columns and how many different values each has: their row groups get a Bloom
    filter, so that a lookup passes over those without the value, which minima and maxima
    of an unordered column cannot tell.  One task writes a bucket, so it is one file; deal
    a key with a third of all rows in a table of its own.
    """
    out = df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).sortBy(key)
    for column, distinct in (lookups or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
        out = out.option(f"parquet.enable.dictionary#{column}", "false")  # a row group with a dictionary writes no filter
    out.saveAsTable(name)


def ordered_view(spark: SparkSession, view: str, table: str, order: list[str]) -> None:
    """A view of a saved table in a stated order, such as a leaderboard; each order is `column [asc|desc] [nulls first|last]`."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM {table} ORDER BY {', '.join(order)}")
