"""Stated rules, each held against its plain form."""

import datetime
import html
import json
import random

from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import evidence, onoff, quality, segments, tenure


def test_rounding_follows_the_binary_value(spark):
    random.seed(2)
    values = [2.675, 0.125, 0.375, 1.005, 2.5, -2.5, 3.5, -2.675, 0.0, 1e-9, 123456.785, 0.285, 1.115, 8.345, -0.5, 0.5, 1e12 + 0.0625, 2.0**43 + 0.5, 2.0**44, 5e-324]
    values += [random.randint(-(10**6), 10**6) / 1000 for _ in range(400)] + [random.uniform(-1e4, 1e4) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    for digits in (0, 1, 2, 4):
        got = [r["r"] for r in df.withColumn("r", S.round_binary(F.col("v"), digits)).orderBy("i").collect()]
        assert got == [round(v, digits) for v in values] + [None]


def test_entities_by_number(spark):
    texts = ["&#65;&#x42; &amp;#67;", "caf&#233; &#x1F600;!", "no &# ref &#; &#x;", "&lt;b&gt; &nbsp;x", "", None, "&#0;&#1114112;"]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.unescape(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got[:3] == ["AB &#67;", "café \U0001f600!", "no &# ref &#; &#x;"]
    assert got[3] == html.unescape(texts[3]).replace("\xa0", " ") and got[4:6] == ["", None]
    assert got[6] == "&#0;&#1114112;"  # no characters


def test_wide_takes_the_first_by_order(spark):
    long = spark.createDataFrame([(1, "a", 3, 9.0), (1, "a", 1, None), (1, "a", 2, 4.0), (1, "b", 5, 1.0), (2, "a", 1, None)], "k int, metric string, at int, v double")
    got = {r["k"]: (r["a__v"], r["b__v"]) for r in segments.wide(long, ["k"], ["a", "b"], ["v"], F.col("at")).collect()}
    assert got == {1: (4.0, 1.0), 2: (None, None)}


def test_pair_gate_names_the_first_fault(spark):
    five, names = "1-2-3-4-5", "a, b, c, d, e"
    own = [("ok", five, names, 10.0), ("dup", five, names, 1.0), ("dup", five, names, 1.0), ("left", five, names, 1.0), ("ids", five, names, 1.0), ("four", "1-2-3-4", names, 1.0), ("names", five, "a, b", 1.0), ("far", five, names, 1.0), *[("cap", f"{i}-2-3-4-5", names, 1.0) for i in range(6)]]
    other = [("ok", five, names, 10.0 + 1e-7), ("dup", five, names, 1.0), ("right", five, names, 1.0), ("ids", "9-2-3-4-5", names, 1.0), ("four", "1-2-3-4", names, 1.0), ("names", five, names, 1.0), ("far", five, names, 1.1), ("cap", five, names, 1.0)]
    make = lambda rows: spark.createDataFrame(rows, "w string, id string, names string, seconds double")
    got = {r["w"]: r["fault"] for r in quality.pair_gate(make(own), make(other), ["w"], "id", "names", "seconds", cap=6).collect()}
    assert got == {
        "ok": None, "dup": "duplicate id", "left": "one-sided", "right": "one-sided", "ids": "ids differ", "four": "not a group", "names": "names do not parse", "far": "exposure differs", "cap": "row cap",
    }


def test_rates_across_teams(spark):
    df = spark.createDataFrame([(1, 110.0, 100, 10, 30, 99.0, 90, 12, 28), (2, None, 0, None, 5, 1.0, None, 3, None)], "k int, p double, n int, o int, d int, opp_p double, opp_n int, opp_o int, opp_d int")
    a, b = df.select("k", *[c.alias(n) for n, c in onoff.cross_rates("p", "n", "o", "d").items()]).orderBy("k").collect()
    assert a.asDict() == {"k": 1, "offensive_rating": 110.0, "defensive_rating": 110.0, "net_rating": 0.0, "off_rebound_pct": 1000 / 38, "def_rebound_pct": 3000 / 42, "total_rebound_pct": 50.0}
    assert b.asDict() == {"k": 2, "offensive_rating": None, "defensive_rating": None, "net_rating": None, "off_rebound_pct": None, "def_rebound_pct": 500 / 8, "total_rebound_pct": None}


def test_windows_are_clipped_to_the_season(spark):
    seasons = spark.sql("select 1 as season, date '2024-01-01' as first, date '2024-01-20' as last union all select 2, date '2024-02-01', date '2024-02-01' union all select 3, null, null")
    events = spark.sql("select 1 as season, date '2024-01-15' as day union all select 1, date '2024-01-20' union all select 1, null union all select 9, date '2024-01-15'")
    got = sorted((r["season"], r["part"], str(r["from_date"]), str(r["to_date"]), r["days"], r["n"]) for r in tenure.window_counts(events, seasons, "season", "day", 14).collect())
    assert got == [(1, 0, "2024-01-01", "2024-01-14", 14, 0), (1, 1, "2024-01-15", "2024-01-20", 6, 2), (2, 0, "2024-02-01", "2024-02-01", 1, 0)]


def test_guidance_by_name(spark):
    recompute, possession = "Prefer component-count recomputation; otherwise use a clearly labelled weighted mean.", "Prefer possession weighting; package career summaries use minutes weighting."
    add, check = "Sum only across non-overlapping segments.", "Check pbpstats definition before interpreting or aggregating."
    want = {
        "OffReboundPct": (recompute, "rebounding"), "ReboundsPer100": (possession, "rebounding"), "Assists": (add, "possession/playmaking"), "Pace": (check, "possession/playmaking"), "Points": (add, "scoring/efficiency"),
        "Blocks": (add, "defence/discipline"), "ShotQuality": (check, "shooting"), "Minutes": (check, "other"),
    }
    names = spark.createDataFrame([(m,) for m in want], "metric string")
    got = {r["metric"]: (r["g"], r["f"]) for r in names.select("metric", S.metric_guidance(F.col("metric")).alias("g"), S.metric_family(F.col("metric")).alias("f")).collect()}
    assert got == want


def test_seasons_with_other_bounds(spark):
    """Two seasons began or ended at other times."""
    years = [1999, 2018, 2019, 2020, 2021]
    first, last = S.season_bounds(F.col("y"))
    got = {r["y"]: (r["a"], r["b"]) for r in spark.createDataFrame([(y,) for y in years], "y int").select("y", first.alias("a"), last.alias("b")).collect()}
    want = {y: (datetime.date(y, 10, 1), datetime.date(y + 1, 4, 30)) for y in years}
    want[2019] = (datetime.date(2019, 10, 1), datetime.date(2020, 8, 31))
    want[2020] = (datetime.date(2020, 12, 1), datetime.date(2021, 5, 31))
    assert got == want


def test_boundary_events(spark):
    day = datetime.date(2024, 2, 1)
    rows = [
        (7, "x", "From Here to There", "Move", 1, day, True, True, True),
        (8, "a-JOHN-doe", "here and there", "Move", 1, day, True, True, True),
        (8, "x", "JOHN DOE: here, there", "Move", 1, day, True, True, True),
        (8, "x", "here and there", "Move", 1, day, False, False, False),
        (7, "x", "only here", "TRADE", 1, day, True, True, False),
        (7, "x", "was traded", "Move", 2, day, True, True, False),
        (7, "x", "was traded", "Move", 3, day, True, False, False),
        (7, "x", "here there", "Trade", 1, datetime.date(2023, 2, 1), True, False, False),
        (7, None, None, None, None, day, True, False, False),
        (None, None, "here there", "Trade", 1, None, False, False, False),
    ]
    df = spark.createDataFrame(rows, "id int, slug string, text string, kind string, team int, day date, a boolean, b boolean, c boolean")
    ident = evidence.names_member(F.col("id"), F.col("slug"), F.col("text"), ("7", "john-doe", "John Doe"))
    loose, strict = evidence.boundary_event(ident, F.col("day"), F.col("text"), F.col("kind"), F.col("team"), 2024, ["here", "there"], ["1", "2"])
    got = df.select("a", "b", "c", ident.alias("i"), loose.alias("l"), strict.alias("s")).collect()
    assert [(r["i"], r["l"], r["s"]) for r in got] == [(r["a"], r["b"], r["c"]) for r in got]


def test_roster_pick(spark):
    long, short = {"personId": 5, "name": "A B"}, {"pid": "6", "fn": "C", "ln": "D"}
    cases = [
        ({"data": {"home": {"teamId": 3, "players": [long]}, "visitor": {"tid": "4", "pl": [short]}}}, [("5", "A B")]),
        ({"home": {"teamId": 9}, "visitor": {"teamId": "", "tid": 3, "players": [], "pl": [short, {"PLAYER_ID": 1, "playerName": " E "}]}}, [("6", "C D"), ("1", "E")]),
        ({"data": {}, "home": {"teamId": 3, "players": [long]}}, []),
        ({"home": {"teamId": 3}, "visitor": {"teamId": 3, "players": [long]}}, []),
        ({"home": {"teamId": 4, "players": [long]}}, []),
        ({}, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, None), (99, "no json")], "i int, p string")
    got = {r["i"]: [tuple(x) for x in r["r"]] for r in df.select("i", evidence.roster_pick(F.col("p"), F.lit(3)).alias("r")).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(cases)}, 98: [], 99: []}


def test_on_off_page(spark):
    def tr(*cells):
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    on, off = ("On Court", "AAA", "1,200", "-", "+1.5", "-2.0", "+3.3"), ("Off Court", "AAA", "300", "-", "1", "2", "3")
    page = "<table class='other'>" + tr(*on) + tr(*off) + "</table><table class='split'>" + tr(*on) + tr("On Court", "AAA") + tr(*off) + tr(*off) + tr(*on) + tr("Off Court", "BBB", *off[2:]) + tr(*off) + tr(*on) + tr("Off Court", "AAA", "n/a", *off[3:]) + tr(*off) + "</table><table class='split'>" + tr(*on) + tr(*off) + "</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table class='split'></table>")], "page int, html string")
    got = evidence.on_off_page(df, "html", ["page"], "split").orderBy("row_index").collect()
    assert [(r["page"], r["team"], r["on_minutes"], r["on_drb_pct"], r["off_minutes"], r["off_trb_pct"], r["swing"]) for r in got] == [(1, "AAA", 1200, -2.0, 300, 3.0, 0.3)] * 2
