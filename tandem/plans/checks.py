"""Set operations, planning and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import onoff, quality
from tandem.plans.impact import FACTS, lineups, members
from tandem.plans.registry import query
from tandem.sources import sinks
from tandem.sources.tables import facts, pending, table


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT struct_pack(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS versions
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q_dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return onoff.dedup_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).where("copies > 1")


@query(f"""WITH {FACTS}, q AS (SELECT member FROM facts GROUP BY member HAVING sum(qty) >= 15000)
SELECT season, count(*) AS lines, count(DISTINCT member) AS members FROM facts WHERE member IN (SELECT member FROM q) GROUP BY season""")
def q_semi_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d)
    qualified = rows.groupBy("member").agg(F.sum("qty").alias("q")).where("q >= 15000")
    return rows.join(qualified, "member", "left_semi").groupBy("season").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("member").alias("members"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def q_anti_missing(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return pending(table(spark, d, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query("""WITH grid AS (SELECT n_nationkey AS team, CAST(y AS INTEGER) AS season FROM nation, range(1995, 2004) t(y)),
seen AS (SELECT DISTINCT c_nationkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT team, season FROM grid ANTI JOIN seen USING (team, season)""")
def q_grid_missing(spark: SparkSession, d: str) -> DataFrame:
    """Nations by seasons, a grid of two small fixed sides, less what there is."""
    seasons = F.explode(F.sequence(F.lit(1995), F.lit(2003))).alias("season")
    grid = table(spark, d, "nation").select(F.col("n_nationkey").alias("team"), seasons)
    seen = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("team"), F.year("o_orderdate").alias("season"))
    return pending(grid, seen, ["team", "season"])


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, count(extra) AS with_extra FROM (
  SELECT o_orderdate, NULL AS extra FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'F') GROUP BY ALL""")
def q_union_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Union by name of seasons whose files differ in columns."""
    o = table(spark, d, "orders")
    whole = o.where("o_orderstatus = 'F'").select("o_orderdate").unionByName(o.where("o_orderstatus <> 'F'").select("o_orderdate", F.col("o_orderpriority").alias("extra")), allowMissingColumns=True)
    return whole.groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct() for s in ("F", "O"))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return quality.report(count(a.intersect(b), "both"), count(a.subtract(b), "first"), count(b.subtract(a), "second"), count(a.union(b).distinct(), "either"))


@query("""WITH t AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS attempts FROM orders GROUP BY ALL) SELECT * FROM t ORDER BY attempts, season, o_custkey LIMIT 20""")
def q_priority_queue(spark: SparkSession, d: str) -> DataFrame:
    """The 20 tasks to do next: fewest attempts, then season, then key."""
    t = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("attempts"))
    return t.orderBy("attempts", "season", "o_custkey").limit(20)


@query("""WITH e AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS expected FROM orders GROUP BY ALL),
f AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS done, bool_and(o_totalprice > 1000) AS all_good FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_custkey, CAST(len(expected) AS INTEGER) AS n_expected, CAST(coalesce(len(done), 0) AS INTEGER) AS n_done, coalesce(len(done) = len(expected), false) AS complete, coalesce(all_good, false) AS all_good FROM e LEFT JOIN f USING (o_custkey)""")
def q_partial_progress(spark: SparkSession, d: str) -> DataFrame:
    """A customer is complete when all its priorities are among its finished orders' ones."""
    o = table(spark, d, "orders")
    expected = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("expected"))
    done = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("done"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_good"))
    have = F.coalesce("done", F.array().cast("array<string>"))
    return expected.join(done, "o_custkey", "left").select(
        "o_custkey", F.size("expected").alias("n_expected"), F.size(have).alias("n_done"), (F.size(F.array_except("expected", have)) == 0).alias("complete"), F.coalesce("all_good", F.lit(False)).alias("all_good")
    )


@query("""WITH a AS (SELECT l_returnflag, sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT l_returnflag, sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' OR l_returnflag <> 'R' GROUP BY ALL),
la AS (SELECT l_returnflag, 'qty' AS field, qty AS v FROM a UNION ALL SELECT l_returnflag, 'n', n FROM a), lc AS (SELECT l_returnflag, 'qty' AS field, qty AS v FROM c UNION ALL SELECT l_returnflag, 'n', n FROM c)
SELECT l_returnflag, field, la.v AS observed, lc.v AS expected FROM la FULL JOIN lc USING (l_returnflag, field) WHERE coalesce(abs(la.v - lc.v) > 1e-6, true)""")
def q_control_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals by return flag against controls from which some returned lines were left out."""
    x = table(spark, d, "lineitem")
    short = x.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderstatus <> 'P' or l_returnflag <> 'R'")
    total = lambda df: df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return quality.control_totals(total(x), total(short), ["l_returnflag"], ["qty", "n"])


@query(f"""WITH {FACTS} SELECT 'order_parts_unique' AS check_name, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_bad, count(*) = 0 AS passed FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
UNION ALL SELECT 'line_keys_unique', n, n = 0 FROM (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'orders_have_items', n, n = 0 FROM (SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL)
UNION ALL SELECT 'quantities_positive', n, n = 0 FROM (SELECT count(*) AS n FROM facts WHERE qty <= 0)
UNION ALL SELECT 'groups_under_500', n, n = 0 FROM (SELECT count(*) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 500))
UNION ALL SELECT 'one_asia', abs(count(*) - 1), count(*) = 1 FROM region WHERE r_name = 'ASIA'""")
def q_quality_report(spark: SparkSession, d: str) -> DataFrame:
    x, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return quality.report(
        quality.unique(x, "order_parts_unique", ["l_orderkey", "l_partkey"]),
        quality.unique(x, "line_keys_unique", ["l_orderkey", "l_linenumber"]),
        quality.same_keys(o.select(F.col("o_orderkey").alias("k")), x.select(F.col("l_orderkey").alias("k")), "orders_have_items", ["k"]),
        quality.gate(facts(spark, d), "quantities_positive", F.col("qty") <= 0),
        quality.gate(lineups(spark, d), "groups_under_500", F.col("n") >= 500),
        quality.exactly_one(table(spark, d, "region").where("r_name = 'ASIA'"), "one_asia"),
    )


@query(f"""WITH {FACTS} SELECT 'facts' AS table_name, season, count(*) AS n_rows FROM facts GROUP BY season
UNION ALL SELECT 'members', season, count(*) FROM (SELECT DISTINCT season, team, member FROM facts) GROUP BY season
UNION ALL SELECT 'orders', CAST(year(o_orderdate) AS INTEGER), count(*) FROM orders GROUP BY ALL""")
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest({"facts": facts(spark, d), "members": members(spark, d), "orders": table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))})


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderstatus AS status, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS level FROM orders GROUP BY ROLLUP (CAST(year(o_orderdate) AS INTEGER), o_orderstatus)""")
def x_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: subtotals by season and status."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("status"))
    return o.rollup("season", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").cast("int").alias("level"))
