"""With / without impact tables over the order fixture.

season = year of the order, team = customer's nation, member = supplier, lineup =
suppliers of an order, exposure = quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import groups, intervals, onoff, ranking, runs
from tandem.plans.registry import query
from tandem.sources.tables import dealt, facts, table

FACTS = """facts AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS team, l_suppkey AS member, l_orderkey, l_partkey, l_quantity AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS points,
    CAST(l_returnflag = 'R' AS BIGINT) AS returned, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
MEMBERS = f"""{FACTS},
m AS (SELECT season, team, member, sum(qty) AS qty, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(returned) AS BIGINT) AS returned, count(*) AS n FROM facts GROUP BY ALL),
t AS (SELECT season, team, sum(qty) AS qty, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(returned) AS BIGINT) AS returned, count(*) AS n FROM facts GROUP BY ALL)"""
ONOFF = f"""{MEMBERS},
s AS (SELECT m.season, m.team, m.member, m.qty AS on_qty, m.cents AS on_cents, m.returned AS on_returned, m.n AS on_n,
  t.qty - m.qty AS off_qty, t.cents - m.cents AS off_cents, t.returned - m.returned AS off_returned, t.n - m.n AS off_n
  FROM m JOIN t ON m.season = t.season AND m.team = t.team)"""
LONG = f"""{ONOFF},
l AS (
  SELECT season, team, member, 'points_per100' AS metric, on_qty AS w_on, off_qty AS w_off, CAST(on_cents AS DOUBLE) / nullif(on_qty, 0) AS "on", CAST(off_cents AS DOUBLE) / nullif(off_qty, 0) AS "off" FROM s
  UNION ALL SELECT season, team, member, 'rebound_pct', on_qty, off_qty, 1e2 * on_returned / nullif(on_n, 0), 1e2 * off_returned / nullif(off_n, 0) FROM s
  UNION ALL SELECT season, team, member, 'attempts', on_qty, off_qty, CAST(on_n AS DOUBLE), CAST(off_n AS DOUBLE) FROM s)"""
METRICS = ["attempts", "points_per100", "rebound_pct"]
SUMS = ["qty", "cents", "returned", "n"]
KEYS = ["season", "team", "member"]


def members(spark: SparkSession, d: str) -> DataFrame:
    """Sums by key; keys are nearly as many as rows, so rows are dealt by key instead of being summed before and after a shuffle."""
    rows = facts(spark, d).select(*KEYS, *SUMS[:-1], F.lit(1).cast("long").alias("n"))
    return groups.additive_totals(dealt(rows, table(spark, d, "lineitem").count(), *KEYS), KEYS, SUMS)


def split(spark: SparkSession, d: str) -> DataFrame:
    on = members(spark, d)
    return onoff.on_off(on, groups.additive_totals(on, KEYS[:2], SUMS), KEYS[:2], SUMS)


def rates(side: str = "") -> dict[str, Column]:
    """The metrics of one side's sums, whose columns begin with `side`."""
    c = lambda name: F.col(f"{side}{name}")
    return {
        "points_per100": F.try_divide(c("cents").cast("double"), F.nullif(c("qty"), F.lit(0.0))),
        "rebound_pct": S.percent(c("returned"), c("n").cast("double")),
        "attempts": c("n").cast("double"),
    }


def long_table(spark: SparkSession, d: str) -> DataFrame:
    on, off = rates("on_"), rates("off_")
    s = split(spark, d).select(*KEYS, F.col("on_qty").alias("w_on"), F.col("off_qty").alias("w_off"), *[side[m].alias(f"{m}_{x}") for x, side in (("on", on), ("off", off)) for m in on])
    return onoff.to_long(s, [*KEYS, "w_on", "w_off"], {m: (f"{m}_on", f"{m}_off") for m in on})


@query(f"WITH {MEMBERS} SELECT * FROM m")
def q_player_totals(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d)


@query(f"WITH {ONOFF} SELECT * FROM s")
def q_on_off_split(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d)


@query(f"""WITH {LONG} SELECT *, "on" - "off" AS on_off FROM l""")
def q_metric_long(spark: SparkSession, d: str) -> DataFrame:
    return long_table(spark, d)


PIVOT = """SELECT season, team, member, max(CASE metric WHEN 'attempts' THEN "on" END) AS attempts, max(CASE metric WHEN 'points_per100' THEN "on" END) AS points_per100,
  max(CASE metric WHEN 'rebound_pct' THEN "on" END) AS rebound_pct FROM l GROUP BY ALL"""


@query(f"WITH {LONG} {PIVOT}")
def q_metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    return onoff.to_wide(long_table(spark, d), KEYS, METRICS, "on", "metric")


CANDIDATES = """seg AS (SELECT {keys}, CAST(sum(CAST(l_returnflag = 'R' AS BIGINT)) AS BIGINT) AS own, CAST(sum(CAST(l_returnflag <> 'R' AS BIGINT)) AS BIGINT) AS hidden, sum(qty) AS exposure FROM {source} GROUP BY ALL),
rated AS (SELECT *, ((2000 * own + own + hidden) // (2 * (own + hidden))) * 10 AS rate, greatest(25, CAST(ceil(exposure * 2.5 + 30) AS BIGINT)) AS cap FROM seg),
ranged AS (SELECT *, CAST(ceil(own * 1e4 / least(10000, rate + 5)) AS BIGINT) - own AS lo,
  CASE WHEN rate <= 5 THEN cap ELSE least(cap, CAST(floor(own * 1e4 / nullif(rate - 5, 0)) AS BIGINT) - own) END AS hi FROM rated),
cand AS (SELECT *, CASE WHEN own > 0 AND rate > 0 AND rate <= 10000 AND hi >= lo THEN range(lo, hi + 1) ELSE CAST([] AS BIGINT[]) END AS candidates FROM ranged)"""
BRANDS = f"""{FACTS}, branded AS (SELECT facts.*, p_brand AS brand FROM facts JOIN part ON l_partkey = p_partkey),
{CANDIDATES.format(keys="season, brand", source="branded")}"""
FINE = f"{FACTS}, {CANDIDATES.format(keys='season, team, member', source='facts')}"


def rated(seg: DataFrame) -> DataFrame:
    """Segments (own, hidden, exposure) with the displayed rate, and what it allows."""
    own, hidden = F.col("own"), F.col("hidden")
    shown = seg.withColumns({"rate": intervals.displayed_rate(own, hidden), "cap": intervals.exposure_cap(F.col("exposure"))})
    return shown.withColumn("candidates", intervals.hidden_counts(own, F.col("rate"), F.col("cap")))


def segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Own and hidden events of each segment, the displayed rate, and what it allows."""
    return rated(rows.groupBy(*keys).agg(F.sum("returned").alias("own"), F.sum(1 - F.col("returned")).alias("hidden"), F.sum("qty").alias("exposure")))


def branded(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "brand")


SHOWN = "own, hidden, rate, cap, CAST(len(candidates) AS INTEGER) AS n_candidates, CAST(list_min(candidates) AS BIGINT) AS least, CAST(list_max(candidates) AS BIGINT) AS most"


def _shown(seg: DataFrame, keys: list[str]) -> DataFrame:
    return seg.select(*keys, "own", "hidden", "rate", "cap", F.size("candidates").alias("n_candidates"), F.array_min("candidates").alias("least"), F.array_max("candidates").alias("most"))


@query(f"WITH {BRANDS} SELECT season, brand, {SHOWN} FROM cand")
def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _shown(segments(branded(spark, d), ["season", "brand"]), ["season", "brand"])


@query(f"WITH {FINE} SELECT season, team, member, {SHOWN} FROM cand")
def q_candidates_fine(spark: SparkSession, d: str) -> DataFrame:
    return _shown(segments(facts(spark, d), KEYS), KEYS)


@query(f"""WITH {BRANDS}, pairs AS (
  SELECT a.season, a.brand, list_sort(list_distinct(flatten(list_transform(a.candidates, lambda x: list_transform(b.candidates, lambda y: x + y))))) AS totals
  FROM cand a JOIN cand b ON a.brand = b.brand AND b.season = a.season + 1)
SELECT season, brand, CAST(len(totals) AS INTEGER) AS n_totals, totals[1] AS least, totals[-1] AS most FROM pairs""")
def q_candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of two neighbouring seasons' candidates."""
    seg = segments(branded(spark, d), ["season", "brand"]).select("season", "brand", "candidates")
    after = seg.select((F.col("season") - 1).alias("season"), "brand", F.col("candidates").alias("next"))
    both = seg.join(after, ["season", "brand"]).select("season", "brand", intervals.sums_of(F.col("candidates"), F.col("next")).alias("totals"))
    return both.select("season", "brand", F.size("totals").alias("n_totals"), F.get("totals", F.lit(0)).alias("least"), F.array_max("totals").alias("most"))


@query(f"""WITH {BRANDS} SELECT brand, count(*) AS seasons, CAST(sum(list_max(candidates)) - sum(list_min(candidates)) + 1 AS BIGINT) AS n_totals, 1 AS n_runs,
  CAST(sum(list_min(candidates)) AS BIGINT) AS least, CAST(sum(list_max(candidates)) AS BIGINT) AS most FROM cand WHERE len(candidates) > 0 GROUP BY brand""")
def q_career_totals(spark: SparkSession, d: str) -> DataFrame:
    """All totals of hidden events that a brand's whole career can have; a season's candidates are one run."""
    seg = segments(branded(spark, d), ["season", "brand"]).where(F.size("candidates") > 0).select("brand", runs.runs_of(F.col("candidates")).alias("runs"))
    seasons = seg.groupBy("brand").agg(F.count(F.lit(1)).alias("seasons"))
    sums = runs.career_sums(seg, ["brand"], "runs").join(seasons, "brand")
    return sums.select("brand", "seasons", runs.size(F.col("totals")).alias("n_totals"), F.size("totals").alias("n_runs"), F.get("totals", F.lit(0))["lo"].alias("least"), F.element_at("totals", -1)["hi"].alias("most"))


BOUNDS = f"""{BRANDS}, c AS (
  SELECT brand, sum(exposure) AS exposure, CAST(sum(own) AS BIGINT) AS own, CAST(sum(list_min(candidates)) AS BIGINT) AS hidden_min, CAST(sum(list_max(candidates)) AS BIGINT) AS hidden_max,
    CAST(sum(CAST(len(candidates) > 1 AS BIGINT)) AS BIGINT) AS ambiguous, count(DISTINCT season) AS seasons
  FROM cand WHERE len(candidates) > 0 GROUP BY brand),
r AS (SELECT *, 1e2 * own / nullif(own + hidden_max, 0) AS pct_min, 1e2 * own / nullif(own + hidden_min, 0) AS pct_max, hidden_min = hidden_max AS exact FROM c),
p AS (SELECT *, CASE WHEN exact THEN pct_min END AS pct_exact FROM r)"""
#: Exposure that a member needs for a rank, by size of the fixture's seasons.
LEAST_EXPOSURE = 100.0


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return intervals.career_bounds(segments(branded(spark, d), ["season", "brand"]), "brand")


@query(f"""WITH {BOUNDS} SELECT *, CASE WHEN exposure >= 100 THEN CAST(row_number() OVER (PARTITION BY exposure >= 100
  ORDER BY coalesce(nullif(pct_exact, 0), nullif(pct_min, 0), -1) DESC, exposure DESC, brand) AS INTEGER) END AS rank FROM p""")
def q_career_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A rate of 0 sorts as a missing one."""
    zero = F.lit(0.0)
    order = [F.coalesce(F.nullif(F.col("pct_exact"), zero), F.nullif(F.col("pct_min"), zero), F.lit(-1.0)).desc(), F.desc("exposure"), F.asc("brand")]
    return ranking.rank_qualified(_bounds(spark, d), F.col("exposure") >= LEAST_EXPOSURE, order)


@query(f"""WITH {BRANDS} SELECT brand, sum(exposure) AS exposure, CAST(sum(own) AS BIGINT) AS own, CAST(sum(candidates[1]) AS BIGINT) AS hidden,
  1e2 * sum(own) / nullif(sum(own) + sum(candidates[1]), 0) AS pct FROM cand GROUP BY brand HAVING bool_and(len(candidates) = 1) AND sum(exposure) >= 100""")
def q_career_exact(spark: SparkSession, d: str) -> DataFrame:
    return intervals.career_exact(segments(branded(spark, d), ["season", "brand"]), "brand", LEAST_EXPOSURE)


MASTER = f"""{ONOFF}, {CANDIDATES.format(keys="season, team, member", source="facts")},
l AS (
  SELECT season, team, member, 'points_per100' AS metric, CAST(on_cents AS DOUBLE) / nullif(on_qty, 0) AS "on" FROM s
  UNION ALL SELECT season, team, member, 'rebound_pct', 1e2 * on_returned / nullif(on_n, 0) FROM s
  UNION ALL SELECT season, team, member, 'attempts', CAST(on_n AS DOUBLE) FROM s), w AS ({PIVOT}),
x AS (SELECT season, team, member, max(qty) AS max_qty FROM facts GROUP BY ALL)"""


@query(f"""WITH {MASTER} SELECT season, team, member, m.qty, m.cents, m.returned, m.n, max_qty, attempts, points_per100, rebound_pct,
  CAST(list_min(candidates) AS BIGINT) AS hidden_min, CAST(list_max(candidates) AS BIGINT) AS hidden_max
  FROM m LEFT JOIN x USING (season, team, member) LEFT JOIN w USING (season, team, member) LEFT JOIN cand USING (season, team, member)""")
def q_master(spark: SparkSession, d: str) -> DataFrame:
    """Totals with the greatest exposure, the wide metrics and the hidden bounds of each key.

    All of them come from one aggregate by key, so the facts are read and shuffled once and nothing is joined.
    """
    sums = [F.sum(c).alias(c) for c in SUMS[:-1]]
    one = facts(spark, d).groupBy(*KEYS).agg(*sums, F.count(F.lit(1)).alias("n"), F.max("qty").alias("max_qty"))
    seg = rated(one.withColumns({"own": F.col("returned"), "hidden": F.col("n") - F.col("returned"), "exposure": F.col("qty")}))
    wide = rates()
    bounds = F.array_min("candidates").alias("hidden_min"), F.array_max("candidates").alias("hidden_max")
    return seg.select(*KEYS, *SUMS, "max_qty", *[wide[m].alias(m) for m in METRICS], *bounds)


@query(f"""WITH {FACTS}, s AS (SELECT member, season, count(*) AS n, CAST(sum(returned) AS BIGINT) AS returned FROM facts GROUP BY ALL)
SELECT member, CAST(sum(returned) AS BIGINT) AS returned, round(sum(returned) / nullif(sum(CASE WHEN returned > 0 THEN returned / (CAST(returned AS DOUBLE) / n) END), 0), 9) AS rate FROM s GROUP BY member""")
def q_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities are what the rates imply; the career rate is returned over their sum."""
    per = facts(spark, d).groupBy("member", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("returned").alias("returned"))
    rate = F.when(F.col("returned") > 0, F.col("returned").cast("double") / F.col("n"))
    return per.groupBy("member").agg(F.sum("returned").alias("returned"), F.round(onoff.ratio_of_sums(F.col("returned").cast("double"), rate), 9).alias("rate"))


@query("""WITH x AS (SELECT l_suppkey AS member, l_quantity AS w, round(l_discount * 100) AS v FROM lineitem)
SELECT member, sum(w * v) / nullif(sum(w), 0) AS mean FROM x GROUP BY member""")
def q_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("member")).agg(onoff.weighted_mean(F.round(F.col("l_discount") * 100), F.col("l_quantity")).alias("mean"))


@query("""WITH x AS (SELECT l_suppkey AS member, l_quantity AS w, CASE WHEN l_returnflag <> 'A' THEN round(l_discount * 100) END AS v FROM lineitem)
SELECT member, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS mean FROM x GROUP BY member""")
def q_weighted_mean_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a value lose their weight too."""
    value = F.when(F.col("l_returnflag") != "A", F.round(F.col("l_discount") * 100))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("member")).agg(onoff.weighted_mean(value, F.col("l_quantity"), pairwise=True).alias("mean"))


@query(f"""WITH {LONG} SELECT member, metric, count(*) AS n, count(DISTINCT season) AS seasons, count(DISTINCT team) AS teams, sum(w_on) AS w_on, sum(w_off) AS w_off,
  round(sum("on" * w_on) / nullif(sum(CASE WHEN "on" IS NOT NULL THEN w_on END), 0), 6) AS mean_on, round(sum("off" * w_off) / nullif(sum(CASE WHEN "off" IS NOT NULL THEN w_off END), 0), 6) AS mean_off,
  min("on") + 0 AS min_on, max("on") + 0 AS max_on FROM l GROUP BY member, metric""")
def q_career_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """The metrics side by side until each member is one row; a member has as many rows as it has seasons and teams, so those are counted in sets."""
    several = lambda c: F.size(F.collect_set(c)).cast("long").alias(f"{c}s")
    on, off = rates("on_"), rates("off_")
    s = split(spark, d).select("member", "season", "team", F.col("on_qty").alias("w_on"), F.col("off_qty").alias("w_off"), *[side[m].alias(f"{m}_{x}") for x, side in (("on", on), ("off", off)) for m in METRICS])
    mean = lambda m, x: F.round(onoff.weighted_mean(F.col(f"{m}_{x}"), F.col(f"w_{x}"), pairwise=True), 6).alias(f"mean_{x}_{m}")
    least = lambda m: ((F.min(f"{m}_on") + 0).alias(f"min_on_{m}"), (F.max(f"{m}_on") + 0).alias(f"max_on_{m}"))
    whole = ["n", "seasons", "teams", "w_on", "w_off"]
    per = dealt(s, table(spark, d, "lineitem").count(), "member").groupBy("member").agg(
        F.count(F.lit(1)).alias("n"), several("season"), several("team"), F.sum("w_on").alias("w_on"), F.sum("w_off").alias("w_off"),
        *[c for m in METRICS for c in (mean(m, "on"), mean(m, "off"), *least(m))],
    )
    own = ["mean_on", "mean_off", "min_on", "max_on"]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{c}_{m}").alias(c) for c in own]) for m in METRICS])
    long = per.select("member", *whole, F.explode(rows).alias("m"))
    return long.select("member", "m.metric", *whole, *[f"m.{c}" for c in own])


@query(f"""WITH {LONG}, k AS (SELECT metric, count(*) AS n, count(DISTINCT member) AS members, count(DISTINCT season) AS seasons, count(DISTINCT team) AS teams,
  count("on") AS n_on, count("off") AS n_off, min("on") + 0 AS min_on, max("on") + 0 AS max_on FROM l GROUP BY metric)
SELECT *, CASE metric WHEN 'rebound_pct' THEN 'rebounding' WHEN 'points_per100' THEN 'scoring/efficiency' ELSE 'other' END AS family,
  CASE metric WHEN 'rebound_pct' THEN 'percentage/share' WHEN 'points_per100' THEN 'rate/rating' ELSE 'count' END AS unit FROM k""")
def q_metric_dictionary(spark: SparkSession, d: str) -> DataFrame:
    k = long_table(spark, d).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("members"), F.count_distinct("season").alias("seasons"), F.count_distinct("team").alias("teams"),
        F.count("on").alias("n_on"), F.count("off").alias("n_off"), (F.min("on") + 0).alias("min_on"), (F.max("on") + 0).alias("max_on"),
    )
    return k.withColumns({"family": S.metric_family(F.col("metric")), "unit": S.metric_unit(F.col("metric"))})


@query(f"""WITH {LONG} SELECT season, count(*) AS n_rows, count(DISTINCT metric) AS metrics, count(DISTINCT member) AS members, sum(w_on) AS exposure, count(*) FILTER ("off" IS NULL) AS without_off FROM l GROUP BY season""")
def q_season_summary(spark: SparkSession, d: str) -> DataFrame:
    return long_table(spark, d).groupBy("season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("metric").alias("metrics"), F.count_distinct("member").alias("members"), F.sum("w_on").alias("exposure"), F.count_if(F.col("off").isNull()).alias("without_off")
    )


@query(f"""WITH {MEMBERS} SELECT member, concat(min(season), '-', lpad(CAST((min(season) + 1) % 100 AS VARCHAR), 2, '0')) AS first_season, concat(max(season), '-', lpad(CAST((max(season) + 1) % 100 AS VARCHAR), 2, '0')) AS last_season,
  count(DISTINCT season) AS seasons, count(DISTINCT team) AS teams, count(*) AS stints, sum(qty) AS exposure FROM m GROUP BY member""")
def q_player_lookup(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).groupBy("member").agg(
        S.season_label(F.min("season")).alias("first_season"), S.season_label(F.max("season")).alias("last_season"), F.count_distinct("season").alias("seasons"), F.count_distinct("team").alias("teams"),
        F.count(F.lit(1)).alias("stints"), F.sum("qty").alias("exposure"),
    )


@query(f"""WITH {FACTS}, w AS (SELECT member, p_name AS label, sum(qty) AS w FROM facts JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT member, label, w AS weight FROM w QUALIFY row_number() OVER (PARTITION BY member ORDER BY w DESC, label) = 1""")
def q_mode_name(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a member are nearly as many as rows, so rows are dealt by both."""
    rows = branded(spark, d).select("member", F.col("p_name").alias("label"), "qty")
    return groups.weighted_mode(dealt(rows, table(spark, d, "lineitem").count(), "member", "label"), "member", "label", "qty")


@query(f"""WITH {FACTS}, s AS (SELECT DISTINCT member, season, team FROM facts)
SELECT member, count(DISTINCT season) AS season_count, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons,
  count(DISTINCT team) AS team_count, string_agg(DISTINCT lpad(CAST(team AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(team AS VARCHAR), 2, '0')) AS teams FROM s GROUP BY member""")
def q_distinct_concat(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return facts(spark, d).groupBy("member").agg(
        F.count_distinct("season").alias("season_count"), joined(F.col("season").cast("string")).alias("seasons"), F.count_distinct("team").alias("team_count"), joined(F.lpad(F.col("team").cast("string"), 2, "0")).alias("teams")
    )


@query("""SELECT l_suppkey AS member, coalesce(max(CASE WHEN l_linenumber = 1 THEN l_quantity END), sum(CASE WHEN l_linenumber <> 1 THEN l_quantity END)) AS total FROM lineitem GROUP BY l_suppkey""")
def q_tot_else_sum(spark: SparkSession, d: str) -> DataFrame:
    """Line 1 stands for a summary row."""
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("member")).agg(onoff.summary_else_sum(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("total"))


def lineups(spark: SparkSession, d: str) -> DataFrame:
    """Orders as groups of their suppliers, an entity id and names in text, with additive sums."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    text = F.transform("ids", lambda x: x.cast("string"))
    return g.select("l_orderkey", F.array_join(text, "-").alias("entity"), F.array_join(F.transform(text, lambda x: F.concat(F.lit("S"), x)), ", ").alias("names"), "qty", "n")


LINEUPS = """g AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS ids, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_orderkey),
e AS (SELECT l_orderkey, unnest(ids) AS member, len(ids) AS size, qty, n FROM g)"""


@query(f"WITH {LINEUPS} SELECT CAST(member AS VARCHAR) AS member, concat('S', member) AS member_name, count(*) AS lineups, sum(qty) AS qty, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY member")
def q_lineup_members(spark: SparkSession, d: str) -> DataFrame:
    rows = lineups(spark, d).withColumns({"ids": groups.split_entity(F.col("entity")), "labels": groups.split_entity(F.col("names"), ",")})
    return groups.member_rows(rows, "ids", names="labels").groupBy("member", "member_name").agg(F.count(F.lit(1)).alias("lineups"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))


@query(f"""WITH {LINEUPS} SELECT size, CAST(count(*) / size AS BIGINT) AS lineups, sum(qty) AS member_qty, size * (SELECT sum(qty) FROM g WHERE len(g.ids) = e.size) AS lineup_qty,
  sum(qty) = size * (SELECT sum(qty) FROM g WHERE len(g.ids) = e.size) AS holds FROM e GROUP BY size""")
def q_lineup_identity(spark: SparkSession, d: str) -> DataFrame:
    """Members' sums are group size times the groups' sums, for every size."""
    g = lineups(spark, d).withColumn("ids", groups.split_entity(F.col("entity"))).withColumn("size", F.size("ids").cast("long"))
    whole = g.groupBy("size").agg(F.count(F.lit(1)).alias("lineups"), F.sum("qty").alias("q"))
    exploded = groups.member_rows(g, "ids").groupBy("size").agg(F.sum("qty").alias("member_qty"))
    return whole.join(exploded, "size").select("size", "lineups", "member_qty", (F.col("size") * F.col("q")).alias("lineup_qty"), (F.col("member_qty") == F.col("size") * F.col("q")).alias("holds"))


@query("""WITH g AS (SELECT l_orderkey, l_suppkey AS m, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.m AS focal, b.m AS mate, count(*) AS shared, sum(a.q) AS focal_qty, sum(b.q) AS mate_qty FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.m <> b.m GROUP BY ALL""")
def q_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Lines are dealt by order, so that an order's sums and its pairs are made in one task without another shuffle."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    g = dealt(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", F.col("l_suppkey").alias("m")).agg(F.sum("l_quantity").alias("q"))
    return groups.pair_rows(g, "l_orderkey", "m", ["q"]).groupBy("focal", "mate").agg(F.count(F.lit(1)).alias("shared"), F.sum("q").alias("focal_qty"), F.sum("mate_q").alias("mate_qty"))


@query("""WITH a AS (SELECT l_suppkey AS member, sum(l_quantity) AS on_qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
b AS (SELECT l_suppkey AS member, sum(l_quantity) AS off_qty FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 3 GROUP BY ALL)
SELECT coalesce(a.member, b.member) AS member, on_qty, off_qty, on_qty - off_qty AS on_off FROM a FULL JOIN b ON a.member = b.member""")
def q_full_outer_onoff(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "member")
    a = x.where("l_returnflag = 'R'").groupBy("member").agg(F.sum("l_quantity").alias("on_qty"))
    b = x.where("l_returnflag = 'A' and l_linenumber < 3").groupBy("member").agg(F.sum("l_quantity").alias("off_qty"))
    return a.join(b, "member", "full_outer").select("member", "on_qty", "off_qty", (F.col("on_qty") - F.col("off_qty")).alias("on_off"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 1)
SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey NOT IN (SELECT l_orderkey FROM p) GROUP BY ALL""")
def q_off_floor_filter(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the orders without supplier 1."""
    x = table(spark, d, "lineitem")
    present = x.where("l_suppkey = 1").select("l_orderkey").distinct()
    rest = x.join(present, "l_orderkey", "left_anti").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rest.groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))
