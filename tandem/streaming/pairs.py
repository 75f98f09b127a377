"""Resumable pair documents: what has been fetched for each focal member of a team and season, and what went wrong.

Results of requests arrive as a stream.  Each focal member has keyed state: whether a
result with metrics has come, how many tries it took, and a bounded list of the last
errors.  A member that is complete ignores what comes later, so a rerun asks only for
the rest.  The stream's checkpoint holds the state: stopped and started again it goes
on where it was, and what is written is what one run writes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Errors that a member and a document keep.
MOST_ERRORS = 100
#: Columns of a result: `metrics` is null where the request failed and 0 where the response held none.
RESULT = "season int, team int, focal long, at timestamp, id long, metrics long, reason string"
_ERROR = "struct<at: timestamp, id: bigint, reason: string>"
UPDATE = f"season int, team int, focal long, version long, complete boolean, tries long, metrics long, errors array<{_ERROR}>"
#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Member(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version long, tries long, metrics long")
        self.errors = handle.getListState("errors", "at timestamp, id long, reason string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, tries, metrics = self.seen.get() if self.seen.exists() else (0, 0, None)
        if metrics is not None:
            return
        kept = list(self.errors.get()) if self.errors.exists() else []
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):  # a batch is as large as the source's limit lets it be
            tries += 1
            if r["metrics"]:
                metrics = r["metrics"]
                break
            kept.append((r["at"], r["id"], r["reason"] if r["metrics"] is None else "no metric results"))
            del kept[:-MOST_ERRORS]
        version += 1
        self.seen.update((version, tries, metrics))
        if kept:
            self.errors.put([tuple(e) for e in kept])
        yield Row(season=key[0], team=key[1], focal=key[2], version=version, complete=metrics is not None, tries=tries, metrics=metrics, errors=[tuple(e) for e in kept])

    def close(self) -> None:
        pass


def member_updates(results: DataFrame) -> DataFrame:
    """A stream of RESULT rows as a stream of UPDATE rows: a member's whole state each time it changes."""
    if results.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"keyed state needs spark.sql.streaming.stateStore.providerClass = {STORE}")
    return results.groupBy("season", "team", "focal").transformWithState(_Member(), UPDATE, "Update", "None")


def land_updates(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes updates of what has arrived since the last run under `path`, one folder a batch, and stops.

    A batch that is run again after a stop writes its own folder again, so nothing
    counts twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return member_updates(results).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """Each member's last state; versions count up, so a row written twice changes nothing."""
    key = ["season", "team", "focal"]
    whole = F.struct(*[F.col(c) for c in ("version", "complete", "tries", "metrics", "errors")])
    return updates.groupBy(*key).agg(F.max_by(whole, "version").alias("s")).select(*key, "s.complete", "s.tries", "s.metrics", "s.errors")


def documents(members: DataFrame, expected: DataFrame, core: DataFrame) -> DataFrame:
    """One row per team and season of `core` (season, team, complete, absent): state, complete, expected, completed, tries, errors.

    state is `error` while the core is incomplete, `absent` for a team that had no
    season (complete, with nothing expected), else `complete` or `partial` by whether all
    of `expected` (season, team, focal) are complete.  n_errors and last_error come
    from the last MOST_ERRORS of the members' last errors, which hold the document's own.
    """
    key = ["season", "team"]
    wanted = expected.select(*key, "focal").distinct().join(members, [*key, "focal"], "left")
    counts = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("expected"), F.count_if("complete").alias("completed"), F.coalesce(F.sum("tries"), F.lit(0)).alias("tries"))
    flat = members.select(*key, F.explode("errors").alias("e")).select(*key, F.struct("e.at", "e.id", "e.reason").alias("e"))
    errors = flat.groupBy(*key).agg(F.least(F.count(F.lit(1)), F.lit(MOST_ERRORS)).alias("n_errors"), F.max("e")["reason"].alias("last_error"))
    out = core.select(*key, F.col("complete").alias("_core"), "absent").join(counts, key, "left").join(errors, key, "left")
    found = F.coalesce(F.col("expected"), F.lit(0)) == F.coalesce(F.col("completed"), F.lit(0))
    state = F.when(~F.col("_core"), "error").when(F.col("absent"), "absent").when(found, "complete").otherwise("partial")
    none = (F.col("_core") & ~F.col("absent")).cast("long")  # an absent or unusable document expects nothing
    zero = lambda c: (F.coalesce(F.col(c), F.lit(0)) * none).alias(c)
    return out.select(*key, state.alias("state"), state.isin("absent", "complete").alias("complete"), zero("expected"), zero("completed"), zero("tries"), zero("n_errors"), F.when(none == 1, F.col("last_error")).alias("last_error"))
