"""Writers: Parquet, nested-to-text CSV, guarded archives, manifests and managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> int:
    """Writes CSV with a header and returns the number of rows, counted on the way."""
    seen = Observation()
    flat(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
    return int(seen.get["n"])


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_archive(df: DataFrame, path: str) -> bool:
    """JSON lines; an empty result never replaces an archive."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    return True


def save_table(df: DataFrame, name: str, sort: list[str], by: list[str] | None = None) -> None:
    """A managed table sorted inside its files, so that readers skip by min/max statistics as an index would."""
    out = df.sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).saveAsTable(name)


def manifest(tables: dict[str, DataFrame], season: str = "season") -> DataFrame:
    """Rows of each table by season."""
    parts = [t.groupBy(F.col(season).alias("season")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "season", "n_rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
