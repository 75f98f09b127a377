"""Landing: keyed streams of results and archives of windows, over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.plans.registry import query
from tandem.sources import archive, scratch
from tandem.sources.tables import table
from tandem.streaming import pairs

RESULTS = """res AS (SELECT CAST(year(ts) AS INTEGER) AS season, CAST(user_id % 20 AS INTEGER) AS team, user_id AS focal, ts, event_id, event_type,
  CASE event_type WHEN 'purchase' THEN 1 + CAST(floor(abs(value)) AS BIGINT) WHEN 'view' THEN 0 END AS metrics FROM events)"""


@query(f"""WITH {RESULTS}, ok AS (SELECT season, team, focal, min(struct_pack(t := ts, i := event_id)) AS first FROM res WHERE metrics > 0 GROUP BY ALL),
r AS (SELECT res.*, ok.first IS NOT NULL AS done FROM res LEFT JOIN ok USING (season, team, focal) WHERE ok.first IS NULL OR struct_pack(t := ts, i := event_id) <= ok.first),
m AS (SELECT season, team, focal, bool_or(done) AS done, count(*) AS tries FROM r GROUP BY ALL),
bad AS (SELECT season, team, least(sum(least(n, 100)), 100)::BIGINT AS n_errors, arg_max(reason, last) AS last_error FROM (
  SELECT season, team, focal, count(*) AS n, max(struct_pack(t := ts, i := event_id)) AS last, arg_max(CASE WHEN metrics = 0 THEN 'no metric results' ELSE event_type END, struct_pack(t := ts, i := event_id)) AS reason
  FROM r WHERE metrics IS NULL OR metrics = 0 GROUP BY ALL) GROUP BY ALL),
want AS (SELECT DISTINCT season, team, focal FROM res WHERE event_type = 'click'),
c AS (SELECT season, team, count(*) AS expected, count(*) FILTER (done) AS completed, coalesce(sum(tries), 0)::BIGINT AS tries FROM want LEFT JOIN m USING (season, team, focal) GROUP BY ALL),
core AS (SELECT season, n_nationkey AS team, n_regionkey <> 3 AS usable, n_nationkey NOT IN (SELECT team FROM res) AS absent FROM nation, (SELECT DISTINCT season FROM res) s)
SELECT core.season, CAST(core.team AS INTEGER) AS team, CASE WHEN NOT usable THEN 'error' WHEN absent THEN 'absent' WHEN coalesce(expected, 0) = coalesce(completed, 0) THEN 'complete' ELSE 'partial' END AS state,
  usable AND (absent OR coalesce(expected, 0) = coalesce(completed, 0)) AS complete,
  CASE WHEN usable AND NOT absent THEN coalesce(expected, 0) ELSE 0 END AS expected, CASE WHEN usable AND NOT absent THEN coalesce(completed, 0) ELSE 0 END AS completed,
  CASE WHEN usable AND NOT absent THEN coalesce(c.tries, 0) ELSE 0 END AS tries, CASE WHEN usable AND NOT absent THEN coalesce(n_errors, 0) ELSE 0 END AS n_errors, CASE WHEN usable AND NOT absent THEN last_error END AS last_error
FROM core LEFT JOIN c ON c.season = core.season AND c.team = core.team LEFT JOIN bad ON bad.season = core.season AND bad.team = core.team""")
def q_pair_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events as results of requests for users, landed through keyed state: a purchase holds metrics, a view none, the rest failed.

    A nation is a team; region 3 has no usable core document, and nations without events were absent.
    """
    events = table(spark, d, "events")
    metrics = F.when(F.col("event_type") == "purchase", 1 + F.floor(F.abs("value")).cast("long")).when(F.col("event_type") == "view", F.lit(0).cast("long"))
    key = [F.year("ts").alias("season"), (F.col("user_id") % 20).cast("int").alias("team"), F.col("user_id").cast("long").alias("focal")]
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")  # a pattern, for the source takes a lone file for no folder
    results = stream.select(*key, F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("id"), metrics.alias("metrics"), F.col("event_type").alias("reason"))
    folder = scratch.folder(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pairs.STORE)
    try:
        pairs.land_updates(results, f"{folder}/updates", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    members = pairs.latest(spark.read.schema(pairs.UPDATE).parquet(f"{folder}/updates"))
    expected = events.where("event_type = 'click'").select(*key)
    teams = events.select(*key[:2]).distinct()
    core = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("team"), (F.col("n_regionkey") != 3).alias("complete"))
    core = core.crossJoin(F.broadcast(teams.select("season").distinct()))  # nations by the few years there are
    core = core.join(teams.select("team").distinct().withColumn("_there", F.lit(True)), "team", "left").select("season", "team", "complete", F.col("_there").isNull().alias("absent"))
    return pairs.documents(members, expected, core)


@query("""SELECT o_orderpriority AS key, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS from_date, strftime(last_day(o_orderdate), '%Y-%m-%d') AS to_date, 'reused' AS state, count(*) AS n_rows,
  round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def q_window_archive(spark: SparkSession, d: str) -> DataFrame:
    """Orders archived by priority and month, admitted again by digest, window and row count, and summed from the archive."""
    day = F.to_date("o_orderdate")
    orders = table(spark, d, "orders").withColumns({"from_date": F.trunc(day, "month").cast("string"), "to_date": F.last_day(day).cast("string")})
    path = f"{scratch.folder(spark)}/archive"
    archive.write_windows(orders, "o_orderpriority", "from_date", "to_date", path)
    rows = archive.revalidated(spark, path).withColumn("row", F.explode_outer("rows"))
    x = F.from_json("row", "o_totalprice double, o_custkey long")
    return rows.select("key", "from_date", "to_date", "state", x.alias("x")).groupBy("key", "from_date", "to_date", "state").agg(F.count("x").alias("n_rows"), F.round(F.sum("x.o_totalprice"), 2).alias("total"), F.count_distinct("x.o_custkey").alias("customers"))
