"""Rosters, moves and their evidence; admission of landed pages and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import htmltables


def roster(active: DataFrame, inactive: DataFrame, keys: list[str]) -> DataFrame:
    """Both lists with a status; who is on both counts as active."""
    a = active.select(*keys).distinct().withColumn("status", F.lit("active_or_dnp"))
    b = inactive.select(*keys).distinct().join(a.select(*keys), keys, "left_anti").withColumn("status", F.lit("inactive"))
    return a.unionByName(b)


def latest(rows: DataFrame, key: str, time: str, value: str, before: Column) -> DataFrame:
    """The value of each key's last row before a time."""
    return rows.where(F.col(time) < before).groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def continuity(rows: DataFrame, key: str, prior: Column, covered: Column, between: Column) -> DataFrame:
    """Per key: the prior affiliation holds, the feed starts early enough, nothing came between; and all three."""
    out = rows.groupBy(key).agg(F.bool_or(prior).alias("prior"), F.bool_or(covered).alias("covered"), F.count_if(between).alias("between"))
    return out.withColumn("continuous", F.col("prior") & F.col("covered") & (F.col("between") == 0))


def move_date(rows: DataFrame, key: str, day: str, fallback: str) -> DataFrame:
    """The earliest candidate day of each key, else a stated one; the source says which."""
    found = rows.groupBy(key).agg(F.min(day).alias("found"))
    return found.select(key, F.coalesce("found", F.lit(fallback).cast("date")).alias(day), F.when(F.col("found").isNull(), "fallback").otherwise("feed").alias("source"))


def expected(actual: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every expectation with what was seen and whether it holds; what is not there does not hold."""
    seen = actual.select(*keys, F.col(value).alias("seen"))
    return wanted.join(seen, keys, "left").withColumn("holds", F.coalesce(F.col("seen") == F.col(value), F.lit(False)))


def find_row(rows: DataFrame, id_col: str, name: str, wanted_id: str, wanted_name: str) -> DataFrame:
    """The rows of an identifier; only where there are none, those whose name holds the wanted one."""
    exact = F.col(id_col).cast("string") == wanted_id
    near = F.lower(name).contains(wanted_name.lower())
    hits = rows.where(exact | near).withColumn("tier", F.when(exact, 1).otherwise(2))
    first = hits.agg(F.min("tier").alias("first"))
    return hits.join(F.broadcast(first), F.col("tier") == F.col("first")).drop("first")  # one row


def first_usable(candidates: DataFrame, key: str, priority: str, usable: Column, value: str) -> DataFrame:
    """Of each key's candidates the usable one of the least priority; none gives null."""
    return candidates.groupBy(key).agg(F.min_by(value, F.when(usable, F.col(priority))).alias(value), F.min(F.when(usable, F.col(priority))).alias(priority))


def admit(tasks: DataFrame, files: int, flags: list[str]) -> DataFrame:
    """A checkpoint is admitted with all its files, every flag set and one validated row; else the first fault is named."""
    fault = F.when(F.col("n_files") != files, "files")
    for f in flags:
        fault = fault.when(~F.coalesce(F.col(f), F.lit(False)), f)
    fault = fault.when(F.col("validated") != 1, "validated")
    return tasks.withColumns({"fault": fault, "admitted": fault.isNull()})


def checkpoint_states(expected_keys: DataFrame, landed: DataFrame, keys: list[str], valid: list[str]) -> DataFrame:
    """(state, n): missing, duplicate, unexpected and invalid keys, and those in order."""
    seen = landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("state").isin(valid)).alias("valid"))
    both = expected_keys.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(seen, keys, "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(~F.col("valid"), "invalid").otherwise("in order")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


#: Cells of an on/off row: its split, team, minutes, then the three rates after one other.
_SPLIT, _TEAM, _MINUTES, _RATES = 0, 1, 2, {"orb_pct": 4, "drb_pct": 5, "trb_pct": 6}


def on_off_page(pages: DataFrame, html: str, keep: list[str], table_class: str) -> DataFrame:
    """(keep, team, on and off minutes and rates, swing) of the first table of a class on each page.

    Rows with fewer than seven cells, with another split than `On Court` or `Off Court` or with
    a number that is none are skipped; an on row counts with the off row that follows it, if
    that is of the same team.  keep identifies a page.
    """
    page = Window.partitionBy(*keep)
    number = lambda i, kind: F.regexp_replace(F.get("cells", F.lit(i)), "[,+]", "").try_cast(kind)
    rows = htmltables.table_rows(pages, html, keep).where(F.array_contains("table_classes", table_class))
    first = rows.withColumn("first", F.min("table_index").over(page)).where((F.col("table_index") == F.col("first")) & (F.size("cells") > max(_RATES.values())))
    read = first.select(*keep, "row_index", F.get("cells", F.lit(_SPLIT)).alias("split"), F.get("cells", F.lit(_TEAM)).alias("team"), number(_MINUTES, "bigint").alias("minutes"), *[number(i, "double").alias(c) for c, i in _RATES.items()])
    kept = read.where(F.col("split").isin("On Court", "Off Court")).dropna(subset=["minutes", *_RATES])
    values = F.struct("split", "team", "minutes", *_RATES)
    pairs = kept.withColumn("off", F.lead(values).over(page.orderBy("row_index"))).where((F.col("split") == "On Court") & (F.col("off.split") == "Off Court") & (F.col("off.team") == F.col("team")))
    sides = [F.col(f"{prefix}{c}").alias(f"{side}_{c}") for side, prefix in (("on", ""), ("off", "off.")) for c in ("minutes", *_RATES)]
    return pairs.select(*keep, "row_index", "team", *sides, F.round(F.col("trb_pct") - F.col("off.trb_pct"), 1).alias("swing"))


_PLAYER = "struct<personId: string, pid: string, PLAYER_ID: string, name: string, playerName: string, firstName: string, fn: string, lastName: string, ln: string>"
_SIDE = f"struct<teamId: string, tid: string, players: array<{_PLAYER}>, pl: array<{_PLAYER}>>"


def roster_pick(payload: Column, team_id: Column) -> Column:
    """array<struct<id, name>>: the players of the wanted team in a game's payload, home first; none where neither side is that team.

    Fields have a long or a short name, and the sides may lie under `data`; blanks, zero as an id and empty lists count as missing.
    """
    body = F.from_json(payload, f"struct<data: struct<home: {_SIDE}, visitor: {_SIDE}>, home: {_SIDE}, visitor: {_SIDE}>")
    there = lambda *cols: F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols])
    some = lambda c: F.when(F.size(c) > 0, c)
    sides = F.when(body["data"].isNotNull(), F.array(body["data"]["home"], body["data"]["visitor"])).otherwise(F.array(body["home"], body["visitor"]))
    mine = F.get(F.filter(sides, lambda s: there(s["teamId"], s["tid"]) == team_id.cast("string")), F.lit(0))
    players = F.coalesce(some(mine["players"]), some(mine["pl"]), F.array().cast(f"array<{_PLAYER}>"))
    whole = lambda p: F.trim(F.concat_ws(" ", F.coalesce(p["firstName"], p["fn"], F.lit("")), F.coalesce(p["lastName"], p["ln"], F.lit(""))))
    named = lambda p: F.trim(F.coalesce(F.nullif(p["name"], F.lit("")), F.nullif(p["playerName"], F.lit("")), whole(p)))
    return F.transform(players, lambda p: F.struct(there(p["personId"], p["pid"], p["PLAYER_ID"]).alias("id"), named(p).alias("name")))


def all_terms(cells: Column, terms: list[str]) -> Column:
    """Do all terms stand in the cells, joined and in lower case?"""
    text, out = F.lower(F.array_join(cells, " ")), F.lit(True)
    for t in terms:
        out = out & text.contains(t)
    return out


def names_member(member_id: Column, slug: Column, text: Column, wanted: tuple[str, str, str]) -> Column:
    """Is a row about the wanted (id, slug, name): the id itself, or the slug or name within, whatever their case?"""
    own, part, name = wanted
    holds = lambda c, x: F.coalesce(F.lower(c).contains(x.lower()), F.lit(False))
    return F.coalesce(member_id.cast("string") == own, F.lit(False)) | holds(slug, part) | holds(text, name)


def boundary_event(ident: Column, day: Column, text: Column, kind: Column, team: Column, year: int, places: list[str], teams: list[str]) -> tuple[Column, Column]:
    """The loose and the strict predicate of a boundary event: a row about the member, in the year, whose text names all
    places; loosely also one of either team that is a trade by its kind or its text.  A row without a day is none."""
    text, kind = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    own = ident & F.coalesce(F.year(day) == year, F.lit(False))
    both = F.lit(True)
    for p in places:
        both = both & text.contains(p)
    trade = (kind.contains("trade") | text.contains("trade")) & F.coalesce(team.cast("string").isin(teams), F.lit(False))
    return own & (both | trade), own & both
