"""Segments with stated errors, complete metric sets, wide tables and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import intervals, onoff, quality, ranking, segments
from tandem.plans.impact import BOUNDS, FACTS, KEYS, LONG, METRICS, _bounds, long_table
from tandem.plans.registry import query
from tandem.sources.tables import facts, table

#: Half the returned quantity stands for a count that need not be an integer; no returns for a missing metric.
SEGMENTS = f"""{FACTS}, g AS (SELECT season, team, member, sum(CASE WHEN returned = 1 THEN qty END) / 2 AS shown, CAST(sum(1 - returned) AS BIGINT) AS rest, sum(qty) AS exposure FROM facts GROUP BY ALL),
i AS (SELECT *, CASE WHEN abs(shown - round(shown)) <= 1e-6 THEN CAST(round(shown) AS BIGINT) END AS own FROM g),
r AS (SELECT *, ((2000 * own + own + rest) // (2 * (own + rest))) * 10 AS rate, greatest(25, CAST(ceil(exposure * 2.5 + 30) AS BIGINT)) AS cap FROM i),
b AS (SELECT *, CAST(ceil(own * 1e4 / least(10000, rate + 5)) AS BIGINT) - own AS lo, CASE WHEN rate <= 5 THEN cap ELSE least(cap, CAST(floor(own * 1e4 / nullif(rate - 5, 0)) AS BIGINT) - own) END AS hi FROM r),
e AS (SELECT season, team, member, own, CASE WHEN own > 0 AND rate > 0 AND rate <= 10000 AND hi >= lo THEN CAST(hi - lo + 1 AS INTEGER) ELSE 0 END AS n FROM b),
d AS (SELECT e.*, CASE WHEN g.shown IS NULL THEN 'missing metric' WHEN own IS NULL THEN 'count is no integer' WHEN n = 0 THEN 'no count fits' END AS error FROM e JOIN g USING (season, team, member))"""


def _derived(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).groupBy(*KEYS).agg((F.sum(F.when(F.col("returned") == 1, F.col("qty"))) / 2).alias("shown"), F.sum(1 - F.col("returned")).alias("rest"), F.sum("qty").alias("exposure"))
    own = S.lenient_long(F.col("shown"))
    rate = F.when(F.col("shown").isNotNull(), F.coalesce(intervals.displayed_rate(own, F.col("rest")), F.lit(0)))
    return segments.derive(rows, F.col("shown"), rate, intervals.exposure_cap(F.col("exposure")))


@query(f"WITH {SEGMENTS} SELECT season, team, member, own, n AS n_candidates, n = 1 AND error IS NULL AS exact, error FROM d")
def q_segment_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every segment, those that cannot be derived with the reason."""
    return _derived(spark, d).select(*KEYS, "own", F.size("candidates").alias("n_candidates"), "exact", "error")


@query(f"WITH {SEGMENTS} SELECT season, count(*) AS segments, count(error) AS errors, bool_and(error IS NULL) AS complete FROM d GROUP BY season")
def q_task_states(spark: SparkSession, d: str) -> DataFrame:
    return segments.task_states(_derived(spark, d), "season")


WIDE = ", ".join(f"""max(CASE metric WHEN '{m}' THEN {v} END) AS {m}__{v.strip('"')}""" for m in METRICS for v in ('"on"', '"off"', "on_off"))


@query(f"""WITH {LONG}, x AS (SELECT *, "on" - "off" AS on_off FROM l) SELECT season, team, member, {WIDE} FROM x GROUP BY ALL""")
def q_metric_wide3(spark: SparkSession, d: str) -> DataFrame:
    """Three values of each metric side by side."""
    return segments.wide(long_table(spark, d), KEYS, METRICS, ["on", "off", "on_off"], F.col("w_on"))


@query(f"""WITH {LONG} SELECT member, metric, round(sum("on" * w_on) / nullif(sum(w_on), 0), 6) AS mean_on, round(sum("off" * w_off) / nullif(sum(w_off), 0), 6) AS mean_off,
  round(sum(("on" - "off") * w_on) / nullif(sum(w_on), 0), 6) AS mean_on_off FROM l GROUP BY ALL""")
def q_career_mean_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The career mean that keeps the weight of rows without value, beside q_career_metric_summary which drops it."""
    mean = lambda v, w: F.round(segments.verbatim_mean(F.col(v), F.col(w)), 6)
    return long_table(spark, d).groupBy("member", "metric").agg(mean("on", "w_on").alias("mean_on"), mean("off", "w_off").alias("mean_off"), mean("on_off", "w_on").alias("mean_on_off"))


FOUR = ["off_count", "off_share", "def_count", "def_share"]
FOUR_SQL = f"""{FACTS}, k AS (SELECT season, team, member, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) AS n FROM facts GROUP BY ALL),
f AS (SELECT season, team, member, CAST(nullif(r, 0) AS DOUBLE) AS off_count, CASE WHEN r > 0 THEN CAST(r AS DOUBLE) / n END AS off_share, CAST(nullif(a, 0) AS DOUBLE) AS def_count, CASE WHEN a > 0 THEN CAST(a AS DOUBLE) / n END AS def_share FROM k)"""


def _four(spark: SparkSession, d: str) -> DataFrame:
    """Long rows of four metrics; a metric without events has no row."""
    k = facts(spark, d).groupBy(*KEYS).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    value = {"off_count": F.col("r"), "off_share": F.col("r") / F.col("n"), "def_count": F.col("a"), "def_share": F.col("a") / F.col("n")}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(m[0].replace("o", "r").replace("d", "a")) > 0, v.cast("double")).alias("value")) for m, v in value.items()])
    return k.select(*KEYS, F.explode(rows).alias("x")).select(*KEYS, "x.*").where("value is not null")


@query(f"WITH {FOUR_SQL} SELECT *, off_count IS NOT NULL AND off_share IS NOT NULL AND def_count IS NOT NULL AND def_share IS NOT NULL AS complete FROM f WHERE off_count IS NOT NULL OR def_count IS NOT NULL")
def q_four_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The four metrics of each key and whether all are there."""
    return segments.metric_set(_four(spark, d), KEYS, FOUR, "value")


@query(f"""WITH {FOUR_SQL}, x AS (SELECT member, 'off_count' AS metric, off_count AS value FROM f UNION ALL SELECT member, 'off_share', off_share FROM f UNION ALL SELECT member, 'def_count', def_count FROM f UNION ALL SELECT member, 'def_share', def_share FROM f)
SELECT metric, member, count(value) AS n, round(sum(value), 9) AS total FROM x WHERE value IS NOT NULL GROUP BY ALL""")
def q_stat_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of stats by key, a blank one among them, flattened to rows by metric."""
    lists = _four(spark, d).groupBy("season", "team", "member").agg(F.collect_list(F.struct(F.concat(F.lit(" "), "metric").alias("stat"), "value")).alias("stats"))
    blank = F.array(F.struct(F.lit("  ").alias("stat"), F.lit(1.0).alias("value")))
    profiles = lists.select("member", F.explode(F.concat("stats", blank)).alias("s")).select("member", "s.*")
    return segments.metric_map(profiles, "member", "stat", ["value"]).groupBy("metric", "member").agg(F.count("value").alias("n"), F.round(F.sum("value"), 9).alias("total"))


@query(f"""WITH {LONG}, x AS (SELECT * FROM l WHERE metric = 'attempts') SELECT CAST(s_suppkey AS BIGINT) AS member, sum(w_on) AS shown FROM supplier LEFT JOIN x ON s_suppkey = member GROUP BY s_suppkey""")
def q_reference_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Each member's exposure as one reference metric shows it, by name; who has no row has none."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), S.plain_name("s_name").alias("name"))
    shown = long_table(spark, d).where("metric = 'attempts'").join(names, "member").groupBy("name").agg(F.sum("w_on").alias("shown"))
    index = onoff.ambiguous_free_index(names, "name", "member")
    return index.join(shown, "name", "left").select("member", "shown")


@query("""SELECT c_custkey, c_name AS name, c_acctbal AS seconds, 'c_mktsegment,c_nationkey' AS extra FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 <> 0""")
def q_exposure_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows with identifier, name and exposure; fields found whatever their case, the others kept as extra."""
    ident = F.when(F.col("c_custkey") % 7 == 0, F.lit("nan")).otherwise(F.col("c_custkey").cast("string"))
    fields = F.create_map(*[x for c in ("c_name", "c_acctbal", "c_nationkey", "c_mktsegment") for x in (F.lit(c.upper()), F.col(c).cast("string"))])
    rows = table(spark, d, "customer").select("c_custkey", ident.alias("id"), fields.alias("fields"))
    rows = rows.withColumns({"name": S.field(F.col("fields"), "c_Name"), "seconds": S.field(F.col("fields"), "C_ACCTBAL")})
    kept = segments.with_exposure(rows, "id", "name", "seconds")
    extra = F.array_join(F.array_sort(F.transform(F.map_keys(S.without(F.col("fields"), "c_name", "c_acctbal")), F.lower)), ",")
    return kept.select("c_custkey", "name", F.col("seconds").cast("double").alias("seconds"), extra.alias("extra"))


ERAS = [(3, 1995, 1997, "CHH"), (3, 1998, 1998, "NOK"), (3, 1999, 2000, "NOH"), (5, 1900, 1999, "NJN"), (7, 1995, 1995, "VAN")]


@query(f"""WITH {FACTS}, k AS (SELECT DISTINCT season, team, upper(left(n_name, 3)) AS now FROM facts JOIN nation ON team = n_nationkey)
SELECT season, team, CASE WHEN team = 3 AND season BETWEEN 1995 AND 1997 THEN 'CHH' WHEN team = 3 AND season = 1998 THEN 'NOK' WHEN team = 3 AND season BETWEEN 1999 AND 2000 THEN 'NOH'
  WHEN team = 5 AND season BETWEEN 1900 AND 1999 THEN 'NJN' WHEN team = 7 AND season = 1995 THEN 'VAN' ELSE now END AS abbr FROM k""")
def q_names_of_eras(spark: SparkSession, d: str) -> DataFrame:
    teams = table(spark, d, "nation").select(F.col("n_nationkey").alias("team"), F.upper(F.substring("n_name", 1, 3)).alias("now"))
    k = facts(spark, d).select("season", "team").distinct().join(F.broadcast(teams), "team")  # 25 nations
    return k.select("season", "team", S.name_of_era(F.col("team"), F.col("season"), ERAS, F.col("now")).alias("abbr"))


@query(f"""WITH {LONG}, names AS (SELECT metric, count(*) AS n FROM l GROUP BY metric)
SELECT metric, n, CASE metric WHEN 'rebound_pct' THEN 'Prefer component-count recomputation; otherwise use a clearly labelled weighted mean.' WHEN 'points_per100' THEN 'Prefer possession weighting; package career summaries use minutes weighting.'
  WHEN 'attempts' THEN 'Sum only across non-overlapping segments.' ELSE 'Check pbpstats definition before interpreting or aggregating.' END AS guidance, CASE metric WHEN 'rebound_pct' THEN 'rebounding' WHEN 'points_per100' THEN 'scoring/efficiency' ELSE 'other' END AS family FROM names""")
def q_metric_guidance(spark: SparkSession, d: str) -> DataFrame:
    """What the names of the long table's metrics say about their use."""
    names = long_table(spark, d).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    return names.select("metric", "n", S.metric_guidance(F.col("metric")).alias("guidance"), S.metric_family(F.col("metric")).alias("family"))


@query(f"""WITH {BOUNDS} SELECT brand, CAST(row_number() OVER (ORDER BY coalesce(pct_exact, 0) DESC, exposure DESC, brand) AS INTEGER) AS rank FROM p WHERE exposure >= 100 AND NOT (exact AND pct_exact < 50.0)""")
def q_rank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of those that pass a threshold only, a blank rate taken for 0."""
    kept = _bounds(spark, d).where((F.col("exposure") >= 100) & ~(F.col("exact") & (F.coalesce("pct_exact", F.lit(0.0)) < 50.0)))
    return ranking.places(kept.select("brand", "exposure", "pct_exact"), {"rank": [F.coalesce("pct_exact", F.lit(0.0)).desc(), F.desc("exposure"), F.asc("brand")]}).select("brand", "rank")


@query(f"""WITH {BOUNDS} SELECT brand, CAST(row_number() OVER (ORDER BY pct_exact DESC NULLS LAST, brand) AS INTEGER) AS nulls_last, CAST(row_number() OVER (ORDER BY coalesce(pct_exact, -999) DESC, brand) AS INTEGER) AS sentinel,
  CAST(row_number() OVER (ORDER BY abs(pct_min - 50), brand) AS INTEGER) AS nearest FROM p""")
def q_sort_variants(spark: SparkSession, d: str) -> DataFrame:
    """The leaderboard's places under three orders: nulls last, a sentinel for missing rates, nearest to a value."""
    orders = {
        "nulls_last": [F.col("pct_exact").desc_nulls_last(), F.asc("brand")], "sentinel": [F.coalesce("pct_exact", F.lit(-999.0)).desc(), F.asc("brand")],
        "nearest": [F.abs(F.col("pct_min") - 50), F.asc("brand")],
    }
    return ranking.places(_bounds(spark, d).select("brand", "pct_exact", "pct_min"), orders).select("brand", *orders)


@query("""WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS urgent FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderdate < DATE '2000-01-01' GROUP BY ALL),
b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, max(o_totalprice) AS dearest FROM orders GROUP BY ALL)
SELECT season, n, coalesce(urgent, 0) AS urgent, dearest, coalesce(urgent, 0) > 0 AS has_urgent FROM s LEFT JOIN a USING (season) LEFT JOIN b USING (season)""")
def q_season_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Scalar lookups joined to a season summary; what has no entry counts 0, a missing flag is false."""
    o = table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    base = o.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("dearest"))
    urgent = o.where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))).groupBy("season").agg(F.count(F.lit(1)).alias("urgent"), F.lit(True).alias("has_urgent"))
    return base.join(urgent, "season", "left").select("season", "n", F.coalesce("urgent", F.lit(0)).alias("urgent"), "dearest", F.coalesce("has_urgent", F.lit(False)).alias("has_urgent"))


@query(f"""WITH {FACTS}, m AS (SELECT member, count(*) AS n, CAST(sum(returned) AS BIGINT) AS r FROM facts GROUP BY member)
SELECT 'rates_in_range' AS check_name, count(*) FILTER (CAST(r AS DOUBLE) / n < 0.3 OR CAST(r AS DOUBLE) / n > 0.4) AS n_bad, count(*) FILTER (CAST(r AS DOUBLE) / n < 0.3 OR CAST(r AS DOUBLE) / n > 0.4) = 0 AS passed FROM m
UNION ALL SELECT 'base_rows_present', count(*) FILTER (s_suppkey IS NULL), count(*) FILTER (s_suppkey IS NULL) = 0 FROM m LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey <> 3) ON member = s_suppkey""")
def q_range_gates(spark: SparkSession, d: str) -> DataFrame:
    """Rates outside a sane range, and members that an inner join with a base table would lose."""
    m = facts(spark, d).groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.sum("returned").alias("r"))
    base = table(spark, d, "supplier").where("s_suppkey <> 3").select(F.col("s_suppkey").alias("member"))
    rate = F.col("r") / F.col("n")
    return quality.report(quality.gate(m, "rates_in_range", ~rate.between(0.3, 0.4)), quality.gate(m.join(base, "member", "left_anti"), "base_rows_present", F.lit(True)))


@query("""WITH e AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(DISTINCT CAST(ts AS DATE)) FILTER (value > 50) AS days FROM events GROUP BY user_id)
SELECT user_id, list_aggregate(ids[-3:], 'string_agg', ',') AS last_three, list_aggregate(ids[:2], 'string_agg', ',') AS first_two, coalesce(array_to_string(list_sort(list_transform(days, lambda x: CAST(x AS VARCHAR))), ','), '') AS days FROM e""")
def q_retention(spark: SparkSession, d: str) -> DataFrame:
    """The last three and first two of each user's events, and the days with a large value in order."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), segments.ordered_ids(F.to_date("ts"), F.col("value") > 50).alias("days"))
    joined = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    return e.select("user_id", joined(segments.last_of(F.col("ids"), 3)).alias("last_three"), joined(F.slice("ids", 1, 2)).alias("first_two"), "days")


@query("""WITH t AS (SELECT l_orderkey, list(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN l_orderkey % 11 <> 0 THEN list_min(q) END AS least, CASE WHEN l_orderkey % 11 <> 0 THEN list_max(q) END AS most FROM t""")
def q_array_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of numbers kept as JSON text; every eleventh text is no JSON."""
    text = F.when(F.col("l_orderkey") % 11 == 0, F.lit("{bad")).otherwise(F.to_json(F.collect_list("l_quantity")))
    least, most = S.bounds_of(F.col("text"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(text.alias("text")).select("l_orderkey", least.alias("least"), most.alias("most"))


@query(f"""WITH {FACTS}, x AS (SELECT member, map(['qty', 'pct_returned', 'lines', 'share_rate'], [CAST(sum(qty) AS DOUBLE), 1e2 * sum(returned) / count(*), CAST(count(*) AS DOUBLE), 0.5]) AS f FROM facts GROUP BY member)
SELECT member, count(*) AS n, sum(v) AS total FROM (SELECT member, unnest(map_keys(f)) AS k, unnest(map_values(f)) AS v FROM x) WHERE k NOT LIKE '%pct%' AND k NOT LIKE '%rate%' GROUP BY member""")
def q_numeric_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numeric fields chosen by tokens of their names; a map exploded, joined with another and filtered by key."""
    m = facts(spark, d).groupBy("member").agg(F.sum("qty").alias("q"), F.sum("returned").alias("r"), F.count(F.lit(1)).cast("double").alias("n"))
    first = F.create_map(F.lit("qty"), F.col("q"), F.lit("pct_returned"), 100.0 * F.col("r") / F.col("n"))
    fields = F.map_filter(F.map_concat(first, F.create_map(F.lit("lines"), F.col("n"), F.lit("share_rate"), F.lit(0.5))), lambda k, _: ~k.rlike("pct|percent|rate|chance"))
    return m.select("member", F.explode(fields).alias("k", "v")).groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, concat(year(o_orderdate), '–', lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')) AS wiki, CAST(o_orderdate AS DATE) AS day,
  CAST(o_orderdate AS DATE) BETWEEN make_date(year(o_orderdate), 10, 1) AND make_date(year(o_orderdate) + 1, 4, 30) AS in_season, CASE WHEN o_totalprice > 1.5 THEN o_totalprice / 100 ELSE o_totalprice END AS share,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS first_id, CAST(o_orderkey AS DOUBLE) AS amount,
  strftime(o_orderdate, '%B %-d, %Y') IS NOT NULL AND o_orderkey % 2 = 0 AS strict, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, CAST(o_orderkey % 1000 AS INTEGER) AS code FROM orders""")
def q_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Labels, dates in several formats, seasons, shares, identifiers, numbers in text and digests."""
    year = F.year("o_orderdate")
    first, last = S.season_bounds(S.season_start(S.season_label(year)))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ident = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" nan ")).otherwise(F.concat("o_custkey", F.lit(".0")))
    words = F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.lit(" or so")))
    message = F.concat(F.lit("failed with code "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" after 3 tries"))
    return table(spark, d, "orders").select(
        "o_orderkey", S.season_start(S.season_label(year)).alias("season"), S.wiki_label(year).alias("wiki"), S.as_date(text).alias("day"), S.as_date(text).between(first, last).alias("in_season"), S.share(F.col("o_totalprice")).alias("share"),
        S.clean_id(ident).alias("id"), S.first_filled(ident, F.col("o_orderkey")).alias("first_id"), S.first_finite(F.lit("nan"), S.plain_number(F.concat(F.lit("+"), F.format_number("o_orderkey", 0)))).alias("amount"),
        S.strict_day(words).alias("strict"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), F.regexp_extract(message, r"code (\d+)", 1).cast("int").alias("code"),
    )
