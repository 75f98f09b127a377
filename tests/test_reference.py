"""Every query against its SQL on the small fixture, and the properties that the survey names."""

import glob
import gzip
import json
import os
import random
import re
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandem.functions import scalars as S
from tandem.operators import groups, intervals, onoff, quality, segments, tenure, textops
from tandem.plans import catalog
from tandem.sources import http, sinks, tables
from tandem.sources.http import get_json
from tandem.streaming import incremental

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_candidates_hold_the_truth_and_nothing_else(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        own, hidden = rng.randint(0, 900), rng.randint(0, 900)
        rate = int((Decimal(own) / Decimal(max(1, own + hidden))).quantize(Decimal("0.001"), ROUND_HALF_UP) * 10000)
        rows.append((own, hidden, rate, 2000))
    df = spark.createDataFrame(rows, "own long, hidden long, rate long, cap long")
    for r in df.withColumn("c", intervals.hidden_counts(F.col("own"), F.col("rate"), F.col("cap"))).collect():
        allowed = [
            o for o in range(2001)
            if r["own"] > 0 and r["rate"] > 0 and abs(Decimal(r["own"]) / (r["own"] + o) - Decimal(r["rate"]) / 10000) <= Decimal("0.0005")
        ]
        assert r["c"] == allowed
        if r["own"] > 0 and r["rate"] > 0:
            assert r["hidden"] in r["c"]


def test_bounds_bracket_the_truth(spark):
    from tandem.plans import impact

    seg = impact.segments(impact.branded(spark, DATA), ["season", "brand"])
    truth = {r["brand"]: r["h"] for r in seg.groupBy("brand").agg(F.sum("hidden").alias("h")).collect()}
    for r in intervals.career_bounds(seg, "brand").collect():
        assert r["hidden_min"] <= truth[r["brand"]] <= r["hidden_max"]


def test_scalars(spark):
    df = spark.createDataFrame([("nan", "12.0000001", " 7.0 ", "02/03/2024"), ("inf", "12.4", "None", "Feb 3, 2024"), ("1e3", "", "abc", "2024-02-03T10:11:12"), ("true", None, None, "never")], "a string, b string, c string, d string")
    got = df.select(S.lenient_double(F.col("a")).alias("a"), S.lenient_long(F.col("b")).alias("b"), S.clean_id(F.col("c")).alias("c"), S.as_date(F.col("d")).cast("string").alias("d")).collect()
    assert [r["a"] for r in got] == [None, None, 1000.0, None]
    assert [r["b"] for r in got] == [12, None, None, None]
    assert [r["c"] for r in got] == ["7", "", "abc", ""]
    assert [r["d"] for r in got] == ["2024-02-03", "2024-02-03", "2024-02-03", None]
    one = spark.range(1).select(
        S.season_label(F.lit(1999)).alias("label"), S.elapsed_seconds(F.lit(5), F.lit("04:30")).alias("e"), S.slug(F.lit("reboundPctOn%")).alias("slug"), S.share(F.lit(48.5)).alias("share"),
        S.uncomment_tables(F.lit("a<!-- <table>x</table> -->b<!-- c -->")).alias("t"), S.percent(F.lit(3.0), F.lit(0.0)).alias("p"),
    ).first()
    assert (one["label"], one["e"], one["slug"], one["share"], one["p"]) == ("1999-00", 2910, "rebound_pct_on", 0.485, None)
    assert one["t"] == "a <table>x</table> b<!-- c -->"


def test_plain_name(spark):
    df = spark.createDataFrame([("Nikola Jokić ",), ("STRASSE",), (None,)], "n string")
    assert [r[0] for r in df.select(S.plain_name("n")).collect()] == ["nikola jokic", "strasse", None]


def test_payloads(spark):
    text = '{"resultSets":[{"name":"A","headers":["X","Y"],"rowSet":[["1","2"],["3","4"]]}]}'
    df = spark.createDataFrame([(text, '{"single_row_table_data":{"v":1}}', '{"other":1}')], "r string, one string, none string")
    row = df.select(tables.result_set(F.col("r"), "A").alias("r"), tables.payload_rows(F.col("one"), "struct<v int>").alias("one"), tables.payload_rows(F.col("none"), "struct<v int>").alias("none")).first()
    assert row["r"] == [{"X": "1", "Y": "2"}, {"X": "3", "Y": "4"}] and row["one"][0]["v"] == 1 and row["none"] is None


def test_as_of_is_strict_on_demand(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 15, "b")], "k int, t int, v string")
    loose = {(r["k"], r["t"]): r["v"] for r in tenure.as_of(left, right, "k", "t", "t", ["v"]).collect()}
    strict = {(r["k"], r["t"]): r["v"] for r in tenure.as_of(left, right, "k", "t", "t", ["v"], strict=True).collect()}
    assert loose == {(1, 10): "a", (1, 20): "b", (2, 5): None}
    assert strict == {(1, 10): None, (1, 20): "b", (2, 5): None}


def test_on_off_table_rows(spark):
    # on / off minutes and rates of two teams, and the swings they give
    df = spark.createDataFrame([("a", 722.0, 50.8, 2767.0, 49.1), ("b", 520.0, 51.7, 2974.0, 51.2)], "team string, on_min double, on double, off_min double, off double")
    swing = {r["team"]: r["s"] for r in df.select("team", F.round(F.col("on") - F.col("off"), 1).alias("s")).collect()}
    assert swing == {"a": 1.7, "b": 0.5}
    mean = df.agg(onoff.weighted_mean(F.col("on"), F.col("on_min")).alias("m")).first()["m"]
    assert abs(mean - (722 * 50.8 + 520 * 51.7) / 1242) < 1e-9


def test_quality_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, v double")
    checks = quality.report(quality.unique(df, "unique", ["k"]), quality.gate(df, "positive", F.col("v") <= 0))
    assert {r["check_name"]: r["n_bad"] for r in checks.collect()} == {"unique": 2, "positive": 0}
    with pytest.raises(ValueError, match="unique: 2"):
        quality.enforce(checks)
    other = df.where("v < 3")
    assert quality.same_keys(df, other, "keys", ["k"]).first()["n_bad"] == 1
    assert all(r["same"] for r in quality.common_fields(df.where("k = 2"), df.where("k = 2"), "k").collect())


def test_members_and_mode(spark):
    g = spark.createDataFrame([("1-2-3", "A, B, C", 4.0), ("1-2", "A, B", 1.0)], "e string, n string, q double").withColumns({"ids": groups.split_entity(F.col("e")), "names": groups.split_entity(F.col("n"), ",")})
    assert groups.member_rows(g, "ids", size=3, names="names").count() == 3
    rows = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (1, "x", 1.0)], "k int, l string, w double")
    assert groups.weighted_mode(rows, "k", "l", "w").first()["l"] == "x"


def test_html_and_json_tables(spark):
    page = spark.createDataFrame([(1, "<h2>Trades</h2><table><tr><td>May 3</td><td><a href='/x'>A</a> to B</td></tr></table><script>no</script><p>end")], "id int, html string")
    got = [(r["tag"], r["heading"], r["table_index"], r["row_index"], r["text"], r["links"]) for r in textops.blocks_of(page, "html", ["id"]).orderBy("block").collect()]
    assert got == [("h2", "Trades", 0, 0, "Trades", []), ("td", "Trades", 1, 1, "May 3", []), ("td", "Trades", 1, 1, "A to B", ["/x"]), ("p", "Trades", 0, 0, "end", [])]
    clash = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "t", "v", '{"x":1}')], "block int, text string, tag string, value string, path string")
    assert [(r[0], r["text"]) for r in textops.blocks_of(clash, "text", ["block", "tag"]).collect()] == [(1, "a"), (1, "b")]
    assert {tuple(r) for r in textops.walk(clash, "path", ["value"]).collect()} == {("v", "$", "object", None), ("v", "$.x", "int", "1")}
    nested = spark.createDataFrame([(1, "<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>", )], "id int, html string")
    assert [(r["table_index"], r["text"]) for r in textops.blocks_of(nested, "html", ["id"]).orderBy("block").collect()] == [(1, "out"), (2, "in")]
    walked = {r["path"]: r["value"] for r in textops.walk(spark.createDataFrame([(1, '{"a":[1,{"b":2.5}]}')], "id int, j string"), "j", ["id"]).collect()}
    assert walked["$.a[1].b"] == "2.5" and walked["$.a[0]"] == "1"


def test_requests_retry_and_report_absence():
    answers = iter([(503, ""), (429, ""), (200, "not json"), (200, '{"a": 1}')])
    assert get_json("u", {}, lambda *_: next(answers), sleep=lambda _: None) == ("ok", '{"a": 1}')
    assert get_json("u", {}, lambda *_: (400, "x"), sleep=lambda _: None) == ("absent", None)
    assert get_json("u", {}, lambda *_: (404, "x"), sleep=lambda _: None)[0] == "error"


def test_requests_wait_as_asked_and_fall_back():
    waits, tries = [], []
    answers = iter([(429, "", "7"), (503, "", "Sat, 28 Nov 2026 00:00:10 GMT"), (500, ""), (500, "")])
    out = http.get_json("u", {}, lambda *_: next(answers), attempts=4, sleep=waits.append, audit=lambda n, s: tries.append(s), jitter=lambda: 0.5, relay=lambda *_: (200, 'Title: x {"a": [1]} end'))
    assert out == ("ok", '{"a": [1]}') and tries == [429, 503, 500, 500] and waits[0] == 7 and waits[2:] == [5.0, 10.0]
    now = datetime(2026, 11, 28, tzinfo=UTC)
    assert http.retry_after("Sat, 28 Nov 2026 00:00:10 GMT", now) == 10 and http.retry_after("soon", now) is None
    assert [http.attempts_for(n) for n in (14, 7, 1)] == [1, 2, 4] and http.json_within("no json [here") is None
    slept, times = [], iter([0.0, 1.0, 1.0, 5.0, 100.0, 100.0])
    paced = http.spaced(lambda *_: (404, "gone"), 8.0, slept.append, lambda: next(times))
    assert [paced("u", {}) for _ in range(2)] == [(404, "gone")] * 2 and slept == [7.0]
    assert http.either(lambda *_: (500, ""), lambda *_: (200, "x"))("u", {}) == (200, "x")


def _answer(url, parameters):
    return (200, '{"n": 1}') if parameters["key"] == "a" else (400, "")


def test_windowed_source(spark):
    spark.dataSource.register(http.windowed_source("windowed_test", _answer))
    windows = json.dumps([["a", "2024-01-01", "2024-01-14"], ["b", "2024-01-01", "2024-01-01"]])
    rows = {r["key"]: (r["state"], r["body"], r["tries"]) for r in spark.read.format("windowed_test").option("windows", windows).option("url", "u").load().collect()}
    assert rows == {"a": ("ok", '{"n": 1}', "0:200"), "b": ("absent", None, "0:400")}


def test_landed_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with gzip.open(tmp_path / name, "wt") if name.endswith(".gz") else open(tmp_path / name, "w", encoding="utf-8") as f:
            f.write(text)

    put("docs/x/a.json.gz", '{"complete": true, "players": [{"id": 1}, {"id": 2}]}')
    put("docs/y/b.json.gz", '{"complete": false, "players": [{"id": 3}]}')
    put("docs/z/c.json.gz", "{broken")
    schema = "complete boolean, players array<struct<id int>>"
    assert tables.read_documents(spark, str(tmp_path / "docs"), schema).count() == 3
    assert sorted(r["id"] for r in tables.read_checkpoints(spark, str(tmp_path / "docs"), schema, "players").collect()) == [1, 2]
    put("lines/a.jsonl.gz", '{"k": 1}\n\n{"k": 2}\n')
    assert tables.read_lines(spark, str(tmp_path / "lines"), "k int").where("k is not null").count() == 2
    put("csv/deep/a.csv", "\ufeffk,v\n1,x\n")
    assert tables.read_csv(spark, str(tmp_path / "csv")).columns == ["k", "v"]
    put("none/a.csv", "")
    for name in ("none", "absent"):
        got = tables.read_csv_or_none(spark, str(tmp_path / name), "k int, v string")
        assert got.columns == ["k", "v"] and got.count() == 0
    for year in (2001, 2002):
        spark.createDataFrame([(1, year), (2, year)], "id int, year int").write.parquet(str(tmp_path / f"y{year}"))
    some = tables.read_years(spark, [str(tmp_path / "y2001"), str(tmp_path / "y2002")], "id", [2])
    assert sorted(r["year"] for r in some.collect()) == [2001, 2002] and re.search(r"PushedFilters: \[[^\]]*(In\(id|EqualTo\(id)", some._jdf.queryExecution().toString())


def test_more_scalars(spark):
    one = spark.range(1).select(
        S.round_half_even(F.lit(2.675), 2).alias("a"), S.round_half_even(F.lit(0.125), 2).alias("b"), S.wiki_label(F.lit(1999)).alias("w"), S.strict_double(F.lit(" ")).alias("d"),
        S.plain_number(F.lit("+1,234.5")).alias("n"), S.full_name(F.lit(" A "), F.lit(""), F.lit("x")).alias("f"), S.request_key(F.lit("e"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("k"),
        S.request_key(F.lit("e"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))).alias("k2"),
    ).first()
    assert (one["a"], one["b"], one["w"], one["d"], one["n"], one["f"]) == (2.68, 0.12, "1999–00", 0.0, 1234.5, "A") and one["k"] == one["k2"]
    with pytest.raises(Exception, match="not a finite number"):
        spark.range(1).select(S.strict_double(F.lit("inf"))).collect()


def test_golden_segment(spark):
    # 43821.9 s, 905 own and 620 hidden events: the displayed rate gives the hidden count back among its candidates
    rows = spark.createDataFrame([(43821.9, "905", 620), (10.0, "x", 1), (10.0, "2.5", 1)], "seconds double, own string, hidden long")
    rate = intervals.displayed_rate(F.col("own").try_cast("long"), F.col("hidden"))
    got = segments.derive(rows, F.col("own"), F.coalesce(rate, F.lit(0)), intervals.exposure_cap(F.col("seconds") / 60)).collect()
    assert 620 in got[0]["candidates"] and got[0]["error"] is None and [r["error"] for r in got[1:]] == ["missing metric", "count is no integer"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "a"), (2, [], "b")], "k int, xs array<int>, s string")
    assert sinks.write_csv(df, str(tmp_path / "csv")) == 2
    assert sorted(tables.read_csv(spark, str(tmp_path / "csv")).collect())[0]["xs"] == "[1,2]"
    assert sinks.write_archive(df, str(tmp_path / "arc")) and not sinks.write_archive(df.limit(0), str(tmp_path / "arc"))
    assert spark.read.json(str(tmp_path / "arc")).count() == 2
    sinks.write_parquet(df, str(tmp_path / "pq"), ["s"])
    assert spark.read.parquet(str(tmp_path / "pq")).where("s = 'a'").count() == 1


def test_resuming(spark, tmp_path):
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    attempts = spark.createDataFrame([(2, 3), (3, 1)], "k int, attempts int")
    assert [(r["k"], r["attempts"]) for r in incremental.todo(key(1, 2, 3, 4), key(4), attempts, ["k"], 10).collect()] == [(1, 0), (3, 1), (2, 3)]
    after = incremental.record(attempts, spark.createDataFrame([(2, True), (3, False), (5, False)], "k int, finished boolean"), ["k"])
    assert {(r["k"], r["attempts"]) for r in after.collect()} == {(3, 2), (5, 1)}
    flags = incremental.plan_flags(key(1, 2), key(1, 2), key(), ["k"]).first()
    assert (flags["has_work"], flags["needs_aggregate"], flags["done"]) == (False, True, False)
    source = str(tmp_path / "in")
    seen = []
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(source)
        incremental.land(spark, source, "id long", str(tmp_path / "cp"), lambda df, _: seen.append(df.count())).awaitTermination()
    assert seen == [3, 4]


def _tasks(df):
    """Partitions of every shuffle that the plan states, by the keys it deals by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), REPARTITION_BY_NUM", plan)


def test_pairs_are_made_where_lines_were_dealt(spark, monkeypatch):
    """The tasks that make pairs follow the rows, and no other shuffle lies before them."""
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = tables.table(spark, DATA, "lineitem").count()
    df = catalog.queries()["q_pair_metrics"](spark, DATA)
    assert {int(n) for _, n in _tasks(df)} == {lines // 500 + 1}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") <= 1  # that of the sums by pair


def test_members_are_summed_where_facts_were_dealt(spark, monkeypatch):
    """Sums by nearly unique keys follow the rows; the summary lays out metrics after its sums."""
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = tables.table(spark, DATA, "lineitem").count()
    for name in ("q_career_metric_summary", "q_player_totals"):
        df = catalog.queries()[name](spark, DATA)
        assert {int(n) for _, n in _tasks(df)} == {lines // 500 + 1}
    plan = catalog.queries()["q_career_metric_summary"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate") and "Expand" not in plan  # the root comes first: metrics are laid out last


def test_labels_are_weighed_where_rows_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = tables.table(spark, DATA, "lineitem").count()
    df = catalog.queries()["q_mode_name"](spark, DATA)
    assert _tasks(df) and {int(n) for _, n in _tasks(df)} == {lines // 500 + 1}
