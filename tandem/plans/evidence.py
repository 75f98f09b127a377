"""Rosters, moves, boundary events, archives and the admission of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import evidence, onoff, quality, ranking, textops
from tandem.plans.registry import query
from tandem.sources import tables
from tandem.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


@query("""WITH a AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'view')
SELECT day, user_id, 'active_or_dnp' AS status FROM a UNION ALL SELECT day, user_id, 'inactive' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.day = b.day AND a.user_id = b.user_id)""")
def q_roster_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Who was there on a day, active or not."""
    e = _events(spark, d)
    return evidence.roster(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["day", "user_id"])


@query("""WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type IN ('purchase', 'view'))
SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM r WHERE r.day = CAST(ts AS DATE) AND r.user_id = events.user_id)""")
def q_same_day_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Clicks on a day for which a roster names the user."""
    return _events(spark, d).where("event_type = 'click'").join(q_roster_evidence(spark, d), ["day", "user_id"], "left_semi").select("event_id", "user_id", "day")


@query("""SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id""")
def q_latest_affiliation(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latest(_events(spark, d), "user_id", "ts", "event_type", F.lit("2024-01-16").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT user_id, bool_or(event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05') AS prior, bool_or(ts < TIMESTAMP '2024-01-02') AS covered,
  count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08') AS between FROM events GROUP BY user_id) SELECT *, prior AND covered AND between = 0 AS continuous FROM c""")
def q_continuity(spark: SparkSession, d: str) -> DataFrame:
    """A prior affiliation, a feed that begins early enough, and nothing in between."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    kind, ts = F.col("event_type"), F.col("ts")
    return evidence.continuity(_events(spark, d), "user_id", (kind == "purchase") & (ts < at("2024-01-05")), ts < at("2024-01-02"), (kind == "click") & (ts >= at("2024-01-05")) & (ts < at("2024-01-08")))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'purchase' AND value > 90 GROUP BY user_id)
SELECT user_id, coalesce(day, DATE '2024-02-01') AS day, CASE WHEN day IS NULL THEN 'fallback' ELSE 'feed' END AS source FROM u LEFT JOIN f USING (user_id)""")
def q_move_date(spark: SparkSession, d: str) -> DataFrame:
    """The first large purchase of each user, else a stated day."""
    e = _events(spark, d).select("user_id", F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), F.col("day")).alias("day"))
    return evidence.move_date(e, "user_id", "day", "2024-02-01")


@query("""WITH a AS (SELECT user_id, 'before' AS side, count(*) > 0 AS there FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY user_id UNION ALL SELECT user_id, 'after', count(*) > 0 FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY user_id),
w AS (SELECT user_id, side, side = 'before' OR user_id % 2 = 0 AS there FROM (SELECT DISTINCT user_id FROM events), (VALUES ('before'), ('after')) v(side))
SELECT user_id, side, w.there, a.there AS seen, coalesce(a.there = w.there, false) AS holds FROM w LEFT JOIN a USING (user_id, side)""")
def q_expectations(spark: SparkSession, d: str) -> DataFrame:
    """What a boundary's two sides should show, and whether they do."""
    e = _events(spark, d)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    side = F.when(F.col("ts") < at("2024-01-03"), "before").when(F.col("ts") >= at("2024-01-28"), "after")
    actual = e.withColumn("side", side).where("side is not null").groupBy("user_id", "side").agg((F.count(F.lit(1)) > 0).alias("there"))
    sides = F.explode(F.array(F.lit("before"), F.lit("after")))
    wanted = e.select("user_id").distinct().select("user_id", sides.alias("side")).withColumn("there", (F.col("side") == "before") | (F.col("user_id") % 2 == 0))
    return evidence.expected(actual, wanted, ["user_id", "side"], "there")


@query("""WITH t AS (SELECT doc_id, lang, source, replace(text, ' this ', ' traded ') AS text, o_orderdate AS day, o_orderpriority AS kind, c_nationkey AS team FROM documents LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN customer ON c_custkey = o_custkey),
m AS (SELECT doc_id, coalesce((doc_id = 7 OR contains(lower(source), 'src1') OR contains(lower(text), 'is and')) AND year(day) IN (1995), false) AS own, coalesce(contains(lower(text), ' for ') AND contains(lower(text), ' of the '), false) AS both_named,
  (contains(lower(coalesce(kind, '')), 'trade') OR contains(lower(coalesce(text, '')), 'trade')) AND coalesce(team < 12, false) AS trade FROM t)
SELECT doc_id, own AND (both_named OR trade) AS loose, own AND both_named AS strict FROM m""")
def q_boundary_events(spark: SparkSession, d: str) -> DataFrame:
    """Texts that tell of a member's move within a year, by id, slug or name, loosely and strictly; one word stands for a verb."""
    moves = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = table(spark, d, "documents").join(moves, F.col("doc_id") == F.col("o_orderkey"), "left").withColumn("text", F.replace("text", F.lit(" this "), F.lit(" traded ")))
    ident = evidence.names_member(F.col("doc_id"), F.col("source"), F.col("text"), ("7", "src1", "Is and"))
    loose, strict = evidence.boundary_event(ident, F.col("o_orderdate"), F.col("text"), F.col("o_orderpriority"), F.col("c_nationkey"), 1995, [" for ", " of the "], [str(i) for i in range(12)])
    return rows.select("doc_id", loose.alias("loose"), strict.alias("strict"))


@query("""SELECT p_partkey, contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand#1') AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'a') AND p_size > 10 AS cells, contains(lower(p_type), 'steel') AS serialised FROM part""")
def q_archive_filter(spark: SparkSession, d: str) -> DataFrame:
    """All terms in a row's cells; and the looser search in the row as JSON text."""
    cells = F.array("p_name", "p_type", "p_brand")
    text = F.lower(F.to_json(F.struct(F.col("p_type"))))
    return table(spark, d, "part").select("p_partkey", (evidence.all_terms(cells, ["brand#1", "a"]) & (F.col("p_size") > 10)).alias("cells"), text.contains("steel").alias("serialised"))


@query("""SELECT 'id' AS how, c_custkey, 1 AS tier FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'name', c_custkey, 2 FROM customer WHERE contains(lower(c_name), '00001')""")
def q_row_find(spark: SparkSession, d: str) -> DataFrame:
    """An exact identifier wins; without one the rows whose name holds the text."""
    c = table(spark, d, "customer")
    one = lambda how, i, n: evidence.find_row(c, "c_custkey", "c_name", i, n).select(F.lit(how).alias("how"), "c_custkey", "tier")
    return one("id", "7", "00001").unionByName(one("name", "none", "00001"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (NOT coalesce(value > 50, false)) AS small FROM events WHERE event_type NOT IN ('view', 'click') AND user_id <> 0 AND user_id < 120 GROUP BY event_type""")
def q_event_codes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(~F.col("event_type").isin("view", "click") & (F.col("user_id") != 0) & (F.col("user_id") < 120))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("value") > 50, F.lit(False))).alias("small"))


@query("""WITH t AS (SELECT o_custkey, CAST(count(*) AS INTEGER) AS n_files, bool_or(o_orderstatus = 'F') AS closed, bool_or(o_orderpriority LIKE '1%') AS rated, CAST(count(*) FILTER (o_totalprice > 200000) AS INTEGER) AS validated FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, CASE WHEN n_files <> 10 THEN 'files' WHEN NOT closed THEN 'closed' WHEN NOT rated THEN 'rated' WHEN validated <> 1 THEN 'validated' END AS fault FROM t) SELECT o_custkey, fault, fault IS NULL AS admitted FROM f""")
def q_admission(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints admitted with all files, flags and one validated row."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("int").alias("n_files"), F.bool_or(F.col("o_orderstatus") == "F").alias("closed"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("rated"), F.count_if(F.col("o_totalprice") > 200000).cast("int").alias("validated")
    )
    return evidence.admit(t, 10, ["closed", "rated"]).select("o_custkey", "fault", "admitted")


@query("""WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), s AS (SELECT o_custkey AS k, count(*) AS n, bool_and(o_orderstatus <> 'P') AS valid FROM orders GROUP BY o_custkey)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN g.k IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' WHEN NOT valid THEN 'invalid' ELSE 'in order' END AS state, count(*) AS n FROM g FULL JOIN s ON g.k = s.k GROUP BY ALL""")
def q_checkpoint_states(spark: SparkSession, d: str) -> DataFrame:
    """Orders as what has landed for customers; those of one segment were not asked for."""
    expected = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    landed = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("state"))
    return evidence.checkpoint_states(expected, landed, ["k"], ["F", "O"])


@query("""WITH s AS (SELECT o_orderpriority AS section, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
SELECT 'sections' AS check_name, abs(count(*) - 5) AS n_bad, count(*) = 5 AS passed FROM s UNION ALL SELECT 'rows_as_summed', abs((SELECT sum(n) FROM s) - (SELECT count(*) FROM orders))::BIGINT, true
UNION ALL SELECT 'unmapped_names', count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0 FROM m""")
def q_archive_gates(spark: SparkSession, d: str) -> DataFrame:
    """Expected row counts, a summary that agrees with its rows, and names that map to nothing."""
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    sections = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    index = onoff.ambiguous_free_index(p, "p_name", "p_partkey")
    lost = p.select("p_name").distinct().join(index, "p_name", "left_anti")
    return quality.report(
        quality.row_count(sections, "sections", 5), quality.same_count(sections.agg(F.sum("n").alias("n")), o.agg(F.count(F.lit(1)).alias("n")), "rows_as_summed", "n"), quality.gate(lost, "unmapped_names", F.lit(True)),
    )


@query("""WITH r AS (SELECT o_orderkey // 64 AS page, o_orderkey % 64 AS place, o_orderkey AS k, o_orderstatus AS split, left(o_orderpriority, 1) IN ('1', '2') AS team, CAST(floor(o_totalprice) AS BIGINT) AS mp, o_orderkey % 300 / 10.0 AS orb, o_orderkey % 70 / 10.0 AS drb, o_custkey % 500 / 10.0 AS trb FROM orders),
n AS (SELECT *, lead(split) OVER w AS s2, lead(team) OVER w AS t2, lead(mp) OVER w AS mp2, lead(orb) OVER w AS orb2, lead(drb) OVER w AS drb2, lead(trb) OVER w AS trb2, lead(k) OVER w AS k2 FROM r WHERE split IN ('F', 'O') AND k % 5 <> 1 AND k % 11 <> 0 WINDOW w AS (PARTITION BY page ORDER BY place))
SELECT page, CASE WHEN team THEN 'A' ELSE 'B' END AS team, mp AS on_minutes, orb AS on_orb_pct, drb AS on_drb_pct, trb AS on_trb_pct, mp2 AS off_minutes, orb2 AS off_orb_pct, drb2 AS off_drb_pct, trb2 AS off_trb_pct, round(trb - trb2, 1) AS swing FROM n WHERE split = 'F' AND s2 = 'O' AND team = t2""")
def q_on_off_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages of up to 64 orders in a table, parsed: short rows, rows without numbers, other splits and a second table do not count."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    rate = lambda c, n: F.format_string("+%.1f", F.col(c) % n / 10)
    split = F.when(F.col("o_orderstatus") == "F", "On Court").when(F.col("o_orderstatus") == "O", "Off <b>Court</b>").otherwise("Total")
    team = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), "A").otherwise("B")
    minutes = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    long = F.concat(cell(F.lit("-")), cell(rate("o_orderkey", 300)), cell(rate("o_orderkey", 70)), cell(rate("o_custkey", 500)))
    tr = F.concat(F.lit("<tr><th>"), split, F.lit("</th>"), cell(team), cell(minutes), F.when(F.col("o_orderkey") % 5 == 1, "").otherwise(long), F.lit("</tr>"))
    rows = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("page"), F.struct(F.col("o_orderkey"), tr.alias("tr")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["tr"]), "\n")
    other = F.lit("<table class='on-off'><tr><td>On Court</td><td>A</td><td>1</td><td>-</td><td>1</td><td>1</td><td>1</td></tr></table>")
    pages = rows.groupBy("page").agg(F.concat(F.lit("<h2>Splits</h2><table class='x on-off'><tr><th>Split</th><th>Team</th></tr>"), body, F.lit("</table>"), other).alias("html"))
    return evidence.on_off_page(pages, "html", ["page"], "on-off").drop("row_index")


@query("""SELECT o_orderkey, nullif(CAST(l_suppkey AS VARCHAR), '0') AS id, 'S' || CASE WHEN o_custkey % 5 = 2 THEN '' ELSE ' ' END || l_suppkey AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE CASE WHEN o_custkey % 5 = 2 THEN l_linenumber % 2 = 1 WHEN o_custkey % 7 = 2 THEN l_linenumber % 2 = 0 ELSE false END""")
def q_roster_pick(spark: SparkSession, d: str) -> DataFrame:
    """An order as a game's payload: its odd lines are the home side, the others the visitors; the players of team 2."""
    k = F.col("l_suppkey").cast("string")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, F.struct(F.col("l_suppkey").alias("personId"), F.concat(F.lit("S"), k).alias("name")))).alias("home"),
        F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.struct(k.alias("pid"), F.lit("S").alias("fn"), k.alias("ln")))).alias("visitor"),
    )
    games = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    sides = F.struct(F.struct((F.col("o_custkey") % 5).alias("teamId"), F.col("home").alias("players")).alias("home"), F.struct((F.col("o_custkey") % 7).alias("tid"), F.array().cast("array<string>").alias("players"), F.col("visitor").alias("pl")).alias("visitor"))
    payload = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(sides.alias("data")))).otherwise(F.to_json(sides))
    return games.select("o_orderkey", F.explode(evidence.roster_pick(payload, F.lit(2))).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority || ' of ' || o_orderkey AS text FROM orders WHERE o_orderkey % 3 <> 0""")
def q_dated_items(spark: SparkSession, d: str) -> DataFrame:
    """Dated items of a page's lists; items without a date are no rows."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit("undated")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    item = F.concat(F.lit("<li class='x'>"), day, F.lit(": <b>"), "o_orderpriority", F.lit("</b> of <i>"), F.col("o_orderkey").cast("string"), F.lit("</i></li>"))
    pages = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(item), "\n"), F.lit("</ul>")).alias("html"))
    return pages.select("o_custkey", F.explode(textops.dated_items(F.col("html"))).alias("i")).select("o_custkey", "i.day", "i.text")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 3 AND 3 AS matches FROM events""")
def q_json_match(spark: SparkSession, d: str) -> DataFrame:
    """Does any number in an event's properties equal 3?"""
    e = table(spark, d, "events").select("event_id", "props")
    hits = textops.walk(e, "props", ["event_id"]).where(textops.matches_value(F.col("kind"), F.col("value"), 3.0)).select("event_id").distinct().withColumn("hit", F.lit(True))
    return e.join(hits, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("matches"))


#: Rows and totals of each order as a JSON response: a list, or one object where there is one row.
ITEM = "struct<part bigint, qty double>"


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CAST(n AS INTEGER) AS n_rows, qty, first_part, CASE WHEN n > 1 THEN 'many' ELSE 'one' END AS shape FROM t""")
def q_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Table payloads decoded in both their shapes, and the row that a team's totals pick."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    text = F.when(F.size("rows") > 1, F.to_json(F.struct(F.col("rows").alias("multi_row_table_data")))).otherwise(F.to_json(F.struct(F.get("rows", F.lit(0)).alias("single_row_table_data"))))
    got = o.select("l_orderkey", F.when(F.size("rows") > 1, "many").otherwise("one").alias("shape"), tables.payload_rows(text, ITEM).alias("rows"))
    first = tables.totals_row(F.col("rows"), lambda x: x["part"] < 0)
    return got.select("l_orderkey", F.size("rows").alias("n_rows"), F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["qty"]).alias("qty"), first["part"].alias("first_part"), "shape")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0""")
def q_result_sets(spark: SparkSession, d: str) -> DataFrame:
    """A named result set of a response, header by position; every fifth response lacks it."""
    row = F.array(*[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")])
    sets = F.array(
        F.struct(F.lit("Other").alias("name"), F.array(F.lit("x")).alias("headers"), F.array(F.array(F.lit("1"))).alias("rowSet")),
        F.struct(F.when(F.col("l_orderkey") % 5 == 0, "Gone").otherwise("Lines").alias("name"), F.array(F.lit("NO"), F.lit("PART"), F.lit("QTY")).alias("headers"), F.collect_list(row).alias("rowSet")),
    )
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(sets.alias("resultSets"))).alias("body"))
    line = o.select("l_orderkey", F.explode(tables.result_set(F.col("body"), "Lines")).alias("r"))
    return line.select("l_orderkey", F.col("r.NO").cast("int").alias("l_linenumber"), F.col("r.PART").cast("bigint").alias("l_partkey"), F.col("r.QTY").cast("double").alias("l_quantity"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """A feed whose rows are objects for some keys and lists under headers for others."""
    o = table(spark, d, "orders")
    objects = F.to_json(F.struct(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("rows")))
    listed = F.to_json(F.struct(F.array(F.lit("o_orderkey"), F.lit("o_totalprice")).alias("headers"), F.collect_list(F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"))).alias("rows")))
    feed = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.col("c_custkey") % 2 == 0, objects).otherwise(listed).alias("body"))
    r = feed.select("c_custkey", F.explode(tables.feed_rows(F.col("body"))).alias("r"))
    return r.select("c_custkey", F.col("r.o_orderkey").cast("bigint").alias("o_orderkey"), F.col("r.o_totalprice").cast("double").alias("o_totalprice"))


@query("""WITH m AS (SELECT l_suppkey, l_returnflag AS metric, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) SELECT * FROM m""")
def q_metric_payload(spark: SparkSession, d: str) -> DataFrame:
    """A map of metrics to rows, and a list of results, out of one response."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    body = m.groupBy("l_suppkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.array(F.struct("n", "qty")))))).alias("body"))
    rows = body.select("l_suppkey", F.explode(tables.metric_map(F.col("body"), "struct<n bigint, qty double>")).alias("metric", "rows"))
    wrapped = rows.select("l_suppkey", "metric", F.to_json(F.struct(F.col("rows").alias("results"))).alias("body"))
    return wrapped.select("l_suppkey", "metric", F.explode(tables.list_results(F.col("body"), "struct<n bigint, qty double>")).alias("r")).select("l_suppkey", "metric", "r.*")


@query("""WITH h AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(url, '^https?://([^/?#]*/[^/?#]*)', 1) AS place, html FROM pages),
p AS (SELECT title, min(page_id) AS first FROM h WHERE length(title) > 30 GROUP BY title), a AS (SELECT place, min(page_id) AS first FROM h GROUP BY place)
SELECT page_id, CASE WHEN p.first < page_id THEN 'payload' WHEN a.first < page_id THEN 'html' WHEN length(html) > 0 THEN 'remote' END AS source, CASE WHEN p.first < page_id THEN p.first WHEN a.first < page_id THEN a.first WHEN length(html) > 0 THEN page_id END AS found
FROM h LEFT JOIN p USING (title) LEFT JOIN a USING (place)""")
def q_page_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each page from the first place that has it: an earlier page's payload (of its title, usable where that is long), an earlier page of its host and first folder, the page itself."""
    title, place = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_extract("url", "^https?://([^/?#]*/[^/?#]*)", 1)
    p = table(spark, d, "pages").select("page_id", title.alias("title"), place.alias("place"), F.length("html").alias("size"))
    candidate = lambda rank, source, found, usable: (F.lit(rank).alias("rank"), usable.alias("usable"), F.struct(F.lit(source).alias("source"), F.col(found).alias("found")).alias("v"))
    first = lambda key: p.join(p.groupBy(key).agg(F.min("page_id").alias("first")), key).where(F.col("first") < F.col("page_id"))
    payloads = first("title").select("page_id", *candidate(0, "payload", "first", F.length("title") > 30))
    cached = first("place").select("page_id", *candidate(1, "html", "first", F.lit(True)))
    remote = p.select("page_id", *candidate(2, "remote", "page_id", F.col("size") > 0))
    return evidence.first_usable(payloads.unionByName(cached).unionByName(remote), "page_id", "rank", F.col("usable"), "v").select("page_id", "v.source", "v.found")


@query("""WITH y AS (SELECT DISTINCT CAST(regexp_extract(link, '[0-9]+') AS INTEGER) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS link FROM pages) WHERE regexp_matches(link, '[0-9]+')),
t AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer) SELECT 'from_links' AS what, count(*) AS n, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most FROM y UNION ALL SELECT 'teams', CASE WHEN n < 29 THEN 30 ELSE n END, 0, CASE WHEN n < 29 THEN 29 ELSE n - 1 END FROM t""")
def q_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Numbers found in links, and active teams with a stated list where too few are found."""
    link = table(spark, d, "pages").select(F.explode(S.links(F.col("html"))).alias("link"))
    years = link.select(F.nullif(F.regexp_extract("link", "[0-9]+", 0), F.lit("")).cast("int").alias("n")).where("n is not null").distinct()
    teams = tables.at_least(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("n")), "n", 29, list(range(30)))
    show = lambda df, what: df.agg(F.count(F.lit(1)).alias("n"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most")).select(F.lit(what).alias("what"), "n", "least", "most")
    return show(years, "from_links").unionByName(show(teams, "teams"))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS s, list_sort(list(DISTINCT l_suppkey)) AS ids FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY ALL)
SELECT a.k, a.s, b.s AS other, len(ids)::INTEGER AS size, abs(a.s - b.s) <= 1e-6 AS equal FROM a JOIN b USING (k) WHERE len(ids) = 5""")
def q_lineup_opponents(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five joined one to one with their opponents' rows, seconds compared."""
    x = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    a = x.groupBy("k").agg(F.sum("l_quantity").alias("s"), F.collect_set("l_suppkey").alias("ids"))
    b = x.where("k % 97 <> 0").groupBy("k").agg(F.sum("l_quantity").alias("other"))
    return a.join(b, "k").where(F.size("ids") == 5).select("k", "s", "other", F.size("ids").alias("size"), (F.abs(F.col("s") - F.col("other")) <= 1e-6).alias("equal"))


@query("""WITH e AS (SELECT user_id AS game, event_id % 5 AS p1, event_id % 7 AS p2, event_type, event_id FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT 'first' AS role, game, p1 AS pid, event_type, event_id FROM e UNION ALL SELECT 'second', game, p2, event_type, event_id FROM e),
g AS (SELECT role, game, pid, min(event_id) FILTER (event_type = 'purchase') AS i, min(event_id) FILTER (event_type = 'click') AS o FROM s GROUP BY ALL) SELECT role, game, pid FROM g WHERE i IS NULL OR (o IS NOT NULL AND o <= i)""")
def q_starters_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Starters with either player column taken for the role."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    roles = F.array(F.struct(F.lit("first").alias("role"), (F.col("event_id") % 5).alias("pid")), F.struct(F.lit("second").alias("role"), (F.col("event_id") % 7).alias("pid")))
    s = e.select(F.col("user_id").alias("game"), "event_type", "event_id", F.explode(roles).alias("r")).select("game", "event_type", "event_id", "r.*")
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_id")))
    return s.groupBy("role", "game", "pid").agg(first("purchase").alias("i"), first("click").alias("o")).where("i is null or (o is not null and o <= i)").select("role", "game", "pid")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'Ann ' || c_mktsegment ELSE c_mktsegment END AS name FROM customer""")
def q_composed_names(spark: SparkSession, d: str) -> DataFrame:
    """First and last names put together, the full name where both are blank."""
    first = F.when(F.col("c_custkey") % 3 == 1, " Ann").otherwise(F.lit(""))
    last = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", S.full_name(first, last, F.col("c_name")).alias("name"))


@query("""WITH s AS (SELECT o_orderpriority AS section, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS unresolved FROM orders GROUP BY ALL) SELECT section, n, unresolved, unresolved = 0 AS complete, CAST(row_number() OVER (ORDER BY n DESC, section) AS INTEGER) AS place FROM s""")
def q_archive_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the combined archive by size, with what is unresolved in each."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("unresolved"))
    return ranking.places(s.withColumn("complete", F.col("unresolved") == 0), {"place": [F.desc("n"), F.asc("section")]})
