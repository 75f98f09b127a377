"""Tenures, boundaries and windows over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators import tenure
from tandem.plans.registry import query
from tandem.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("""SELECT o_orderkey, 'home' AS role, c_nationkey AS team FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT o_orderkey, 'away', s_nationkey FROM (SELECT o_orderkey, min(l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) JOIN supplier ON s_suppkey = s""")
def q_participants(spark: SparkSession, d: str) -> DataFrame:
    """An order as a game of its customer's nation and its first supplier's; orders without items have one side."""
    t = lambda n: table(spark, d, n)
    first = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey")).join(t("supplier"), "s_suppkey").select("o_orderkey", "s_nationkey")
    games = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(first, "o_orderkey", "left")
    return tenure.participants(games, {"home": "c_nationkey", "away": "s_nationkey"}, ["o_orderkey"]).where("team is not null")


MARKS = "marks AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


@query(f"""WITH {MARKS} SELECT user_id, count(*) FILTER (ts < mark) AS n_before, min(ts) FILTER (ts < mark) AS first_before, max(ts) FILTER (ts < mark) AS last_before,
  count(*) FILTER (ts > mark) AS n_after, min(ts) FILTER (ts > mark) AS first_after, max(ts) FILTER (ts > mark) AS last_after FROM events JOIN marks USING (user_id) GROUP BY user_id""")
def q_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Events strictly before and after each user's last purchase."""
    e = _events(spark, d)
    marks = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return tenure.before_after(e, marks, "user_id", "ts", "mark")


@query("""WITH m AS (SELECT event_id AS mark_id, CAST(ts AS DATE) AS mark_day FROM events WHERE event_type = 'purchase')
SELECT mark_id, CAST(ts AS DATE) - mark_day AS days_off, count(*) AS n FROM events JOIN m ON abs(CAST(ts AS DATE) - mark_day) <= 2 GROUP BY ALL""")
def q_near_days(spark: SparkSession, d: str) -> DataFrame:
    """Events of the days around every purchase; they are counted by day first, so a mark meets 5 rows at most."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    marks = e.where("event_type = 'purchase'").select(F.col("event_id").alias("mark_id"), F.col("day").alias("mark_day"))
    daily = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return tenure.near_days(daily, marks, "day", "mark_day", 2).select("mark_id", F.datediff("day", "mark_day").cast("long").alias("days_off"), "n")


@query("""WITH m AS (SELECT event_id AS mark_id FROM events WHERE event_type = 'purchase')
SELECT mark_id, event_id, event_type, event_id - mark_id AS off FROM events JOIN m ON event_id BETWEEN mark_id - 6 AND mark_id + 6""")
def q_near_seq(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    marks = e.where("event_type = 'purchase'").select(F.col("event_id").alias("mark_id"))
    return tenure.near_numbers(e, marks, "event_id", "mark_id", 6).select("mark_id", "event_id", "event_type", (F.col("event_id") - F.col("mark_id")).alias("off"))


ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS other_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT l.event_id, l.user_id, l.ts, r.other_id, r.ts AS matched_ts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {} r.ts"""


def _asof(spark: SparkSession, d: str, **how) -> DataFrame:
    e = _events(spark, d)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), "user_id", "ts")
    return tenure.as_of(left, right, "user_id", "ts", "ts", ["other_id"], **how)


@query(ASOF.format(">="))
def q_asof_prev(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d)


@query(ASOF.format("<="))
def q_asof_next(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, forward=True)


@query("""WITH moves AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY o_custkey),
over AS (SELECT o_custkey, day, 'earlier' AS side FROM moves WHERE o_custkey % 3 = 0)
SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, over.side, CASE WHEN over.side IS NULL THEN 'manual review' ELSE 'override' END AS status
FROM orders o JOIN moves m ON o.o_custkey = m.o_custkey AND CAST(o.o_orderdate AS DATE) = m.day LEFT JOIN over ON over.o_custkey = o.o_custkey AND over.day = m.day""")
def q_same_day_override(spark: SparkSession, d: str) -> DataFrame:
    """Orders on a customer's last day need a ruling; only every third customer has one."""
    games = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    moves = games.groupBy("o_custkey").agg(F.max("day").alias("day"))
    overrides = moves.where("o_custkey % 3 = 0").withColumn("side", F.lit("earlier"))
    return tenure.same_day(games, moves, overrides, "o_custkey", "day")


@query("""SELECT CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 14) AS INTEGER) AS part, event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY ALL""")
def q_tumbling_14d(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts")
    return _events(spark, d).groupBy(tenure.tumbling(day, 14, "2024-01-01").alias("part"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("""WITH RECURSIVE limits AS (SELECT count(*) // 8 AS most FROM events),
w AS (
  SELECT DATE '2024-01-01' AS a, DATE '2024-01-30' AS b, 0 AS depth, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS n
  UNION ALL
  SELECT x.a, x.b, x.depth, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN x.a AND x.b) AS n FROM (
    SELECT CASE WHEN side = 0 THEN w.a ELSE w.a + CAST((w.b - w.a) // 2 + 1 AS INTEGER) END AS a, CASE WHEN side = 0 THEN w.a + CAST((w.b - w.a) // 2 AS INTEGER) ELSE w.b END AS b, w.depth + 1 AS depth
    FROM w, limits, (VALUES (0), (1)) sides(side) WHERE w.n >= most AND w.a < w.b) x)
SELECT CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, CAST(depth AS INTEGER) AS depth, n, CASE WHEN n < most THEN 'success' WHEN a < b THEN 'split' ELSE 'failed' END AS status FROM w, limits""")
def q_bisect_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of January are halved until each has under an eighth of the events."""
    e = _events(spark, d)
    return tenure.bisect_windows(e, "ts", "2024-01-01", "2024-01-30", max(1, e.count() // 8))


STARTERS = """WITH e AS (SELECT user_id AS game, CAST(floor(value * 100) AS BIGINT) % 7 AS pid, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'purchase', 'view')),
g AS (SELECT game, pid, min(CASE WHEN event_type = 'purchase' THEN struct_pack(t := ts, i := event_id) END) AS first_in, min(CASE WHEN event_type = 'click' THEN struct_pack(t := ts, i := event_id) END) AS first_out FROM e GROUP BY ALL)
SELECT game, pid FROM g WHERE first_in IS NULL OR (first_out IS NOT NULL AND first_out <= first_in)"""


@query(STARTERS)
def q_starters(spark: SparkSession, d: str) -> DataFrame:
    """Who was there from the start: seen in a game, and not first seen coming in (purchase stands for in, click for out)."""
    e = _events(spark, d).where(F.col("event_type").isin("click", "purchase", "view")).select(F.col("user_id").alias("game"), (F.floor(F.col("value") * 100).cast("long") % 7).alias("pid"), "event_type", "ts", "event_id")
    at = F.struct("ts", "event_id")
    first = e.groupBy("game", "pid").agg(F.min(F.when(F.col("event_type") == "purchase", at)).alias("first_in"), F.min(F.when(F.col("event_type") == "click", at)).alias("first_out"))
    return first.where("first_in is null or (first_out is not null and first_out <= first_in)").select("game", "pid")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, lead(event_type) OVER w AS next_type, lead(value) OVER w AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, value AS on_value, next_value AS off_value, value - next_value AS swing FROM e WHERE event_type = 'click' AND next_type = 'purchase'""")
def q_on_off_pairs(spark: SparkSession, d: str) -> DataFrame:
    """An `on` row pairs with the next row if that is the `off` row of the same key; anything between breaks the pair."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, d).withColumns({"next_type": F.lead("event_type").over(by), "off_value": F.lead("value").over(by)})
    return e.where("event_type = 'click' and next_type = 'purchase'").select("user_id", "event_id", F.col("value").alias("on_value"), "off_value", (F.col("value") - F.col("off_value")).alias("swing"))


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT day, event_type, n, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS last_7, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, day)::INTEGER AS rank FROM f""")
def x_rolling_week(spark: SparkSession, d: str) -> DataFrame:
    """Extension: rolling sums and ranks over daily counts."""
    f = _events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    week = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return f.select("day", "event_type", "n", F.sum("n").over(week).alias("last_7"), F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "day")).alias("rank"))
