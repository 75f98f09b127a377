"""Tenures and boundaries: before and after, nearest in time, as-of, and date windows that split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def participants(games: DataFrame, sides: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per side of a game; an equi join on it replaces `home = x or away = x`."""
    parts = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("team")) for role, c in sides.items()])
    return games.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.role", "p.team")


def _axis(time: Column, kind: str) -> Column:
    """A time as a number, by which buckets are cut."""
    if kind.startswith("timestamp"):
        return F.unix_micros(time.cast("timestamp"))
    return F.unix_date(time).cast("long") if kind == "date" else time.cast("double")


def _bucket(at: Column, cuts: list, low: int = 0) -> Column:
    """Which of len(cuts) + 1 buckets a number falls into: a search tree of comparisons, all of it compiled."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(at <= F.lit(cuts[middle]), _bucket(at, cuts[:middle], low)).otherwise(_bucket(at, cuts[middle + 1 :], low + middle + 1))


def as_of(
    left: DataFrame, right: DataFrame, key: str | list[str], left_time: str, right_time: str, values: list[str], forward: bool = False, strict: bool = False, buckets: int | None = None
) -> DataFrame:
    """left with the latest right row at or before its time (forward: the earliest at or after).

    Both sides are laid into one timeline per key, cut at quantiles of time into
    buckets.  The last right row is carried within (key, bucket); a bucket's head, where
    none has been seen yet, is filled from a small table of each key's last right row by
    bucket.  So a key with most rows is spread over all tasks, and the join costs a sort
    and no pairs.  Rows of one key at one instant share a bucket.

    A null key or time on the left stays without a match; on the right it matches
    nothing.  Of several right rows at one time the one with the greatest values wins
    (forward: the least).  Repeated left rows each give a row; an empty right side gives
    nulls.  `buckets` defaults to eight for each shuffle partition, at most 1024.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kind = dict(left.dtypes)[left_time]
    n = buckets or min(1024, 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead_right = 0 if not strict else 1  # at equal times the right row comes first unless the match is strict
    carried = F.struct(F.col(right_time).alias("_at"), *[F.col(v).alias(v) for v in values])
    ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    known = right.where(F.col(right_time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    r = known.select(*ks, F.col(right_time).alias("_t"), F.lit(lead_right).alias("_s"), carried.alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    le = left.select(*ks, F.col(left_time).alias("_t"), F.lit(1 - lead_right).alias("_s"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), whole.alias("_l"))
    at = _axis(F.col("_t"), kind)
    times = r.select(at.alias("x")).unionAll(le.select(at.alias("x")))
    cuts = times.agg(F.percentile_approx("x", [i / n for i in range(1, n)], 10 * n)).first()[0] or [] if n > 1 else []
    line = r.unionByName(le).withColumn("_b", _bucket(at, sorted(set(cuts))))
    names = [f"_k{i}" for i in range(len(keys))]
    turn = F.desc if forward else F.asc
    within = Window.partitionBy(*names, "_b").orderBy(turn("_t"), F.asc("_s"), turn("_r")).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("_m", F.last("_r", ignorenulls=True).over(within)).where("_l is not null")
    # a table of at most (keys x buckets) rows: what each bucket hands on to those after it
    handed = line.groupBy(*names, "_b").agg((F.min if forward else F.max)("_r").alias("_tail"))
    by = Window.partitionBy(*names).orderBy(turn("_b"))
    handed = handed.withColumn("_head", F.last("_tail", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).where("_head is not null").drop("_tail")
    filled = seen.join(handed, [*names, "_b"], "left").withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce("_m", "_head")))
    return filled.select("_l.*", *[F.col(f"_m.{v}").alias(v) for v in values], F.col("_m._at").alias(f"matched_{right_time}"))


def near_days(events: DataFrame, marks: DataFrame, event_day: str, mark_day: str, days: int) -> DataFrame:
    """Events within `days` of a mark: each mark meets the events of its 2 * days + 1 days by equality."""
    spread = marks.withColumn("_day", F.explode(F.sequence(F.date_sub(mark_day, days), F.date_add(mark_day, days))))
    return events.join(spread, events[event_day] == spread["_day"]).drop("_day")


def near_numbers(events: DataFrame, marks: DataFrame, key: str, mark_key: str, reach: int) -> DataFrame:
    """Events whose number is within reach of a mark's, by equality on the numbers around each mark."""
    spread = marks.withColumn("_n", F.explode(F.sequence(F.col(mark_key) - reach, F.col(mark_key) + reach)))
    return events.join(spread, events[key] == spread["_n"]).drop("_n")


def before_after(events: DataFrame, marks: DataFrame, key: str, time: str, mark_time: str) -> DataFrame:
    """Per key: first, last and number of events strictly before and strictly after its mark."""
    joined = events.join(marks, key)
    before, after = F.col(time) < F.col(mark_time), F.col(time) > F.col(mark_time)
    parts = []
    for name, cond in (("before", before), ("after", after)):
        parts += [F.count_if(cond).alias(f"n_{name}"), F.min(F.when(cond, F.col(time))).alias(f"first_{name}"), F.max(F.when(cond, F.col(time))).alias(f"last_{name}")]
    return joined.groupBy(key).agg(*parts)


def same_day(games: DataFrame, moves: DataFrame, overrides: DataFrame, key: str, day: str) -> DataFrame:
    """Games on the day of a move take the override's side; without one they go to manual review, never guessed."""
    hit = games.join(moves.select(key, F.col(day).alias("_move")), key).where(F.col(day) == F.col("_move")).drop("_move")
    out = hit.join(overrides, [key, day], "left")
    return out.withColumn("status", F.when(F.col("side").isNull(), "manual review").otherwise("override"))


def tumbling(time: Column, days: int, origin: str) -> Column:
    """Number of the window of `days` days from origin that a time falls into."""
    return F.floor(F.datediff(time, F.lit(origin).cast("date")) / days).cast("int")


def window_counts(events: DataFrame, ranges: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """(key, part, from_date, to_date, days, n): contiguous windows of each range (key, first, last), the last one clipped, and their events.

    Events are counted by day first and find their window by number.  A range without
    ends has no windows; events outside all ranges or without a day are not counted.
    """
    count = F.floor(F.datediff("last", "first") / days).cast("int")
    part = F.explode(F.when(F.col("last") >= F.col("first"), F.sequence(F.lit(0), count)))
    spans = ranges.select(key, "first", "last", part.alias("part"))
    start = F.date_add("first", F.col("part") * days)
    spans = spans.select(key, "part", start.alias("from_date"), F.least("last", F.date_add(start, days - 1)).alias("to_date"))
    daily = events.where(F.col(day).isNotNull()).groupBy(key, F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    placed = daily.join(ranges, key).where(F.col("_day").between(F.col("first"), F.col("last"))).groupBy(key, F.floor(F.datediff("_day", "first") / days).cast("int").alias("part")).agg(F.sum("_n").alias("n"))
    return spans.join(placed, [key, "part"], "left").select(key, "part", "from_date", "to_date", (F.datediff("to_date", "from_date") + 1).alias("days"), F.coalesce("n", F.lit(0)).alias("n"))


def bisect_windows(events: DataFrame, time: str, start: str, end: str, most: int) -> DataFrame:
    """Splits [start, end] at start + days div 2 until each window has fewer than `most` events or is one day.

    The driver holds windows only (at most two a day); counts come from one grouped daily
    table, joined to all open windows of a round at once.
    """
    spark = events.sparkSession
    daily = events.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n")).cache()
    span = spark.sql(f"select date '{start}' as a, date '{end}' as b, 0 as depth")
    done = None
    while True:
        counted = span.join(daily, F.col("day").between(F.col("a"), F.col("b")), "left").groupBy("a", "b", "depth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        rows = counted.collect()
        schema = "a date, b date, depth int, n long"
        open_ = [r for r in rows if r["n"] >= most and r["a"] < r["b"]]
        kept = spark.createDataFrame([(r["a"], r["b"], r["depth"], r["n"], "split" if r in open_ else "failed" if r["n"] >= most else "success") for r in rows], schema + ", status string")
        done = kept if done is None else done.unionByName(kept)
        if not open_:
            daily.unpersist()
            return done
        halves = []
        for r in open_:
            middle = r["a"].fromordinal(r["a"].toordinal() + (r["b"] - r["a"]).days // 2)
            halves += [(r["a"], middle, r["depth"] + 1), (middle.fromordinal(middle.toordinal() + 1), r["b"], r["depth"] + 1)]
        span = spark.createDataFrame(halves, "a date, b date, depth int")
