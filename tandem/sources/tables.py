"""Readers of landed data: fixture tables, result sets, payloads, documents and delimited files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a fixture folder.
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their season (year), team (customer's nation) and member (supplier); money in cents."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return items.select(
        F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("team"), F.col("l_suppkey").alias("member"),
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("points"), (F.col("l_returnflag") == "R").cast("long").alias("returned"), "l_returnflag",
    )


#: Rows that a task holds at most where rows are dealt for a join with themselves or for groups nearly as many as rows.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as n rows ask for.

    Groups by these keys, or by more, are then made in one pass after the shuffle: a task holds TASK_ROWS rows' worth
    of them, whatever the size of the input, and no task before it a table of its own.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS + 1)
    return rows.repartition(tasks, *keys)


def payload_rows(text: Column, row: str, many: str = "multi_row_table_data", one: str = "single_row_table_data") -> Column:
    """Rows of a table payload in JSON: a list, or a single object; null when it has neither (an error of the payload)."""
    parsed = F.from_json(text, f"{many} array<{row}>, {one} {row}")
    return F.coalesce(parsed[many], F.when(parsed[one].isNotNull(), F.array(parsed[one])))


def result_set(text: Column, name: str) -> Column:
    """Rows, as maps from header to value, of the named result set of a JSON response."""
    sets = F.from_json(text, "resultSets array<struct<name string, headers array<string>, rowSet array<array<string>>>>")["resultSets"]
    chosen = F.get(F.filter(sets, lambda s: s["name"] == name), F.lit(0))
    return F.transform(chosen["rowSet"], lambda r: F.map_from_arrays(chosen["headers"], r))


def metric_map(text: Column, row: str) -> Column:
    """A JSON object of metric -> rows."""
    return F.from_json(text, f"map<string, array<{row}>>")


def list_results(text: Column, row: str) -> Column:
    """The list under `results`; none where it is missing."""
    return F.coalesce(F.from_json(text, f"results array<{row}>")["results"], F.array().cast(f"array<{row}>"))


def totals_row(rows: Column, wanted: Callable[[Column], Column]) -> Column:
    """The only row, else the wanted one, else the first, else null."""
    hits = F.filter(rows, wanted)
    return F.when(F.size(rows) == 1, F.get(rows, F.lit(0))).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.get(rows, F.lit(0))))


def feed_rows(text: Column) -> Column:
    """Rows of a feed as maps: objects as they are, lists under their headers (or columns)."""
    lists = F.from_json(text, "headers array<string>, columns array<string>, rows array<array<string>>")
    objects = F.from_json(text, "rows array<map<string, string>>")["rows"]
    names = F.coalesce(lists["headers"], lists["columns"])
    return F.when(names.isNotNull(), F.transform(lists["rows"], lambda r: F.map_from_arrays(names, r))).otherwise(objects)


def at_least(found: DataFrame, column: str, least: int, stated: list[int]) -> DataFrame:
    """The distinct values found, or the stated ones where fewer than `least` were."""
    values = found.select(column).distinct()
    few = values.agg((F.count(F.lit(1)) < least).alias("few"))
    fallback = found.sparkSession.createDataFrame([(x,) for x in stated], f"{column} long")
    one = lambda df, want: df.crossJoin(F.broadcast(few)).where(F.col("few") == want).select(column)  # one row
    return one(values, False).unionByName(one(fallback, True))


def read_checkpoints(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The rows of all complete checkpoint documents under a folder of folders, a column `complete` in each."""
    docs = read_documents(spark, path, schema).where("complete")
    return docs.select(F.explode(rows).alias("_r")).select("_r.*")


def read_years(spark: SparkSession, paths: list[str], key: str, wanted: list[int]) -> DataFrame:
    """Parquet files of several years as one table; the filter on keys reaches the scan."""
    return spark.read.parquet(*paths).where(F.col(key).isin(wanted))


def read_csv_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, or a table without rows where there is no file or an empty one."""
    try:
        return spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv*").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file (gzip too); a damaged file reads as one row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gzip too); blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """CSV with a header, found recursively; a byte order mark goes from the first name."""
    out = spark.read.option("header", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv*").csv(path)
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not landed yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
