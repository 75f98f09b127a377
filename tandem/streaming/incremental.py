"""Resumable work: what is left to do, upserts of attempts, and available-now streams.

The reference resumes batches from checkpoints; here that is an anti join, or a
stream that reads what has landed since its last run and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def todo(tasks: DataFrame, done: DataFrame, attempts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Unfinished tasks, those with the fewest attempts first."""
    left = tasks.join(done.select(*keys), keys, "left_anti").join(attempts.select(*keys, "attempts"), keys, "left")
    return left.withColumn("attempts", F.coalesce("attempts", F.lit(0))).orderBy("attempts", *keys).limit(most)


def record(attempts: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The attempts table after a run: finished tasks go, failed ones count one more, the rest stay."""
    failed = results.where(~F.col("finished")).select(*keys, F.lit(1).alias("more"))
    kept = attempts.select(*keys, "attempts").join(results.where("finished").select(*keys), keys, "left_anti")
    both = kept.join(failed, keys, "full_outer")
    return both.select(*keys, (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("attempts"))


def plan_flags(tasks: DataFrame, done: DataFrame, aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """One row: is there work, is everything landed but not summed up, is all done."""
    left = tasks.join(done.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("left"))
    return left.crossJoin(aggregated.agg((F.count(F.lit(1)) > 0).alias("summed"))).select(  # two single rows
        (F.col("left") > 0).alias("has_work"), ((F.col("left") == 0) & ~F.col("summed")).alias("needs_aggregate"), ((F.col("left") == 0) & F.col("summed")).alias("done")
    )


def land(spark: SparkSession, source: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `each` on the files that came since the last run, then stops; the checkpoint makes a rerun resume."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Extension: counts per time window and key, rows up to `late` behind the newest still counted."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
