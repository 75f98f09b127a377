"""Stated rules in one piece each: gates of paired answers, rates across teams, clipped windows, queues and table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import htmltables, intervals, onoff, quality, tenure
from tandem.plans.impact import FINE, KEYS, segments
from tandem.plans.registry import query
from tandem.sources.tables import facts, table


@query("""WITH a AS (SELECT o_custkey, o_orderpriority AS id, o_totalprice AS s FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_custkey, o_orderpriority AS id, o_totalprice AS s FROM orders WHERE o_orderstatus <> 'F'),
x AS (SELECT o_custkey, id, sum(l)::BIGINT AS na, sum(r)::BIGINT AS nb, max(sa) AS sa, max(sb) AS sb FROM (SELECT o_custkey, id, 1 AS l, 0 AS r, s AS sa, NULL AS sb FROM a UNION ALL SELECT o_custkey, id, 0, 1, NULL, s FROM b) GROUP BY ALL),
w AS (SELECT o_custkey, sum(na)::BIGINT AS n_own, sum(nb)::BIGINT AS n_other, max(greatest(na, nb)) AS most, bool_or(na = 0 OR nb = 0) AS differ, bool_or(len(string_split(id, '-')) <> 2) AS members, bool_or(len(string_split(replace(id, '-', ','), ',')) <> 2) AS names,
  bool_or(coalesce(abs(sa - sb) > 1e-6, false)) AS apart FROM x GROUP BY o_custkey)
SELECT o_custkey, n_own, n_other, CASE WHEN n_own >= 9 OR n_other >= 9 THEN 'row cap' WHEN n_own = 0 OR n_other = 0 THEN 'one-sided' WHEN most > 1 THEN 'duplicate id' WHEN differ THEN 'ids differ' WHEN members THEN 'not a group' WHEN names THEN 'names do not parse'
  WHEN apart THEN 'exposure differs' END AS fault FROM w""")
def q_pair_gate(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders that are not open against those that are not finished: pending ones stand on both sides."""
    side = lambda status: table(spark, d, "orders").where(F.col("o_orderstatus") != status).select("o_custkey", F.col("o_orderpriority").alias("id"), F.replace("o_orderpriority", F.lit("-"), F.lit(",")).alias("names"), F.col("o_totalprice").alias("seconds"))
    return quality.pair_gate(side("O"), side("F"), ["o_custkey"], "id", "names", "seconds", cap=9, members=2)


@query("""WITH x AS (SELECT c_nationkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season, l_quantity AS q, l_returnflag AS f, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT season, team, sum(q) FILTER (f <> 'N') AS p, count(*) FILTER (f <> 'N') AS n, count(*) FILTER (f = 'R') AS o, count(*) FILTER (f = 'A') AS r,
  sum(q) FILTER (f = 'N') AS op, count(*) FILTER (f = 'N') AS n2, count(*) FILTER (f = 'N' AND line < 3) AS oo, count(*) FILTER (f = 'N' AND line >= 3) AS r2 FROM x GROUP BY ALL)
SELECT season, team, 1e2 * p / nullif(n, 0) AS offensive_rating, 1e2 * op / nullif(n2, 0) AS defensive_rating, 1e2 * p / nullif(n, 0) - 1e2 * op / nullif(n2, 0) AS net_rating,
  1e2 * o / nullif(o + r2, 0) AS off_rebound_pct, 1e2 * r / nullif(r + oo, 0) AS def_rebound_pct, 1e2 * (o + r) / nullif(o + r + oo + r2, 0) AS total_rebound_pct FROM t""")
def q_team_rates(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were judged (returned or accepted) are the team's, the others its opponent's; each rebounds what the other missed."""
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mine, early = F.col("l_returnflag") != "N", F.col("l_linenumber") < 3
    totals = items.groupBy(F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("team")).agg(
        F.sum(F.when(mine, F.col("l_quantity"))).alias("points"), F.count_if(mine).alias("possessions"), F.count_if(F.col("l_returnflag") == "R").alias("oreb"), F.count_if(F.col("l_returnflag") == "A").alias("dreb"),
        F.sum(F.when(~mine, F.col("l_quantity"))).alias("opp_points"), F.count_if(~mine).alias("opp_possessions"), F.count_if(~mine & early).alias("opp_oreb"), F.count_if(~mine & ~early).alias("opp_dreb"),
    )
    return totals.select("season", "team", *[c.alias(n) for n, c in onoff.cross_rates("points", "possessions", "oreb", "dreb").items()])


@query(f"""WITH {FINE}, q AS (SELECT member FROM cand GROUP BY member HAVING sum(exposure) >= 3000)
SELECT season, team, count(*) AS n_open FROM cand WHERE member IN (SELECT member FROM q) AND len(candidates) <> 1 GROUP BY ALL""")
def q_fallback_queue(spark: SparkSession, d: str) -> DataFrame:
    """Teams and seasons to fetch in full, because a qualified member's segment there has no single candidate."""
    return intervals.fallback_queue(segments(facts(spark, d), KEYS), "member", 3000.0, ["season", "team"])


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT season, min(day) AS a, max(day) AS b FROM o GROUP BY season),
w AS (SELECT season, i::INTEGER AS part, a + (14 * i)::INTEGER AS from_date, least(b, a + (14 * i + 13)::INTEGER) AS to_date FROM (SELECT season, a, b, unnest(range(0, (b - a) // 14 + 1)) AS i FROM s))
SELECT w.season, part, CAST(from_date AS DATE) AS from_date, CAST(to_date AS DATE) AS to_date, CAST(to_date - from_date + 1 AS INTEGER) AS days, count(day) AS n FROM w LEFT JOIN o ON o.season = w.season AND day BETWEEN from_date AND to_date GROUP BY ALL""")
def q_season_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen-day windows of every season, the last one clipped to the season's end, and their orders."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"))
    seasons = o.groupBy("season").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return tenure.window_counts(o, seasons, "season", "day", 14)


NAV = "'<nav>\\s*<ul>(.*?)</ul>'"


@query(f"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, {NAV}, 1), '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages),
i AS (SELECT page_id, unnest(items) AS item, unnest(range(len(items))) AS row_index FROM n)
SELECT page_id, 'Unsectioned' AS section, CAST(NULL AS VARCHAR) AS subsection, 1 AS table_index, 'nav wide' AS table_classes, CAST(row_index AS INTEGER) AS row_index, regexp_extract(item, '>([^<]*)</a>', 1) AS cell,
  regexp_extract(item, '>([^<]*)</a>', 1) AS link_text, regexp_extract(item, 'href="([^"]*)"', 1) AS href FROM i""")
def q_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each page's navigation list written as a table and read back by row, with its cells, links and classes."""
    html = F.col("html")
    for old, new in ((r"<nav>\s*<ul>", '<nav><table class="nav  wide">'), (r"(?s)</ul>\s*</nav>", "</table></nav>"), (r"<li>(<a href=\"[^\"]*\">[^<]*</a>)</li>", "<tr><td>$1</td></tr>")):
        html = F.regexp_replace(html, old, new)
    rows = htmltables.table_rows(table(spark, d, "pages").select("page_id", html.alias("html")), "html", ["page_id"])
    link = F.get("links", F.lit(0))
    return rows.select("page_id", "section", "subsection", "table_index", F.array_join("table_classes", " ").alias("table_classes"), "row_index", F.get("cells", F.lit(0)).alias("cell"), link["text"].alias("link_text"), link["href"].alias("href"))
