"""Constrained nearest matches: equal keys first, then the edit distance of two names, then the best few rows.

Names are looked up in an index of q-grams under a prefix filter, and rows are laid out
only until a name has as many neighbours as are wanted: of a thousand rows of the same
name, those nearest in number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import ranking, tenure
from tandem.sources.scratch import kept


def _grams(text: Column, q: int) -> Column:
    """Numbered q-grams: the second `an` of banana is another gram than the first."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(0))), lambda i: F.substring(text, i, F.lit(q)))
    grams = F.when(F.length(text) >= q, each).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat_ws("\0", g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))


def gram_size(at_most: float) -> int:
    """Characters of a gram: as many as leave names of a few characters certain to share one, three at most."""
    return min(3, max(1, int(0.6 / at_most))) if at_most > 0 else 3


def near_names(left: DataFrame, right: DataFrame, on: list[str], text: str, other_text: str, at_most: float) -> DataFrame:
    """(on, text, other_text, distance) for distinct names of left and right whose normalised edit distance is at most `at_most` (below 1).

    Two names of n and m characters, n the greater, within at_most * n edits share at
    least n - q + 1 - at_most * n * q of their q-grams.  So one of a name's rarest
    grams, as many as it can miss and one more, is among the other's: only these are
    joined, within equal `on`, and what has met is measured.  Names too short for a
    common gram to be certain, at most `small` characters, meet by length instead.
    A null name or key has no neighbour.
    """
    q = gram_size(at_most)
    share = 1 - at_most * q  # of a name's length; what remains is q - 1
    small = math.floor((q - 1) / share + 1e-9) if share > 0 else -1
    sides = []
    for df, name, least in ((left, text, True), (right, other_text, False)):
        sides.append(df.select(*on, F.col(name).alias("_name"), F.lit(least).alias("_left")).where(F.col("_name").isNotNull()).distinct())
    names = sides[0].unionByName(sides[1])
    grams = names.where(F.length("_name") > small).withColumn("_g", F.explode(_grams(F.col("_name"), q)))
    rare = grams.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = grams.join(rare, [*on, "_g"]).groupBy(*on, "_name", "_left").agg(F.array_sort(F.collect_list(F.struct("_n", "_g"))).alias("_all"))
    # of a pair the longer name sets the least number in common; a name's own length is a bound from below
    common = F.ceil(F.length("_name") * share - (q - 1) - 1e-9)
    prefix = F.slice("_all", F.lit(1), F.greatest(F.size("_all") - F.greatest(common, F.lit(1)) + 1, F.lit(1)).cast("int"))
    index = ranked.select(*on, "_name", "_left", F.explode(F.transform(prefix, lambda x: x["_g"])).alias("_g"))
    if small > 0:  # short names meet all names of a length within reach
        n, reach = F.length("_name"), 1 - at_most
        short = names.where(n <= small / reach)
        met_by = F.when(F.col("_left"), F.sequence(F.floor(n * reach), F.ceil(n / reach))).otherwise(F.array(n.cast("long")))
        index = index.unionByName(short.select(*on, "_name", "_left", F.explode(met_by.cast("array<string>")).alias("_g")))
    a = index.where("_left").select(*on, "_g", F.col("_name").alias(text))
    b = index.where("not _left").select(*on, "_g", F.col("_name").alias(other_text))
    longest = F.greatest(F.length(text), F.length(other_text))
    met = a.join(b, [*on, "_g"]).where(F.abs(F.length(text) - F.length(other_text)) <= at_most * longest).select(*on, text, other_text).distinct()
    return met.withColumn("distance", S.edit_ratio(F.col(text), F.col(other_text))).where(F.col("distance") <= at_most)


def laid_out(rows: DataFrame, on: list[str], key: str, text: str, number: str, at_most: float = 0.6, keep: int = 5, steps: tuple[float, ...] = (0.3,)) -> DataFrame:
    """What `best_matches` ranks: (on, _text, _number, other, distance, gap), enough neighbours for every text and number.

    Names are sought at growing distances (none, `steps`, at_most), and a name with
    enough rows at one distance is not sought at the next.  Of each name, rows are taken
    by number around the own one: `keep` and one more numbers below and above, found by
    an as-of join, with the least keys of each.
    """
    need = keep + 1  # a row is its own nearest
    given = rows.select(*on, F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(number).cast("double").alias("_number")).dropna()
    name, spot = [*on, "_text"], [*on, "_text", "_number"]
    nth = F.row_number().over(Window.partitionBy(*spot).orderBy("_key"))  # the optimiser keeps `need` of each before the shuffle
    spots = given.withColumn("_nth", nth).where(F.col("_nth") <= need).groupBy(*spot).agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    spots = ranking.numbered(spots, [F.asc(c) for c in spot], "_seq")
    # a name's rows, as far as they count, and what stands before its first number
    names = kept(spots.groupBy(*name).agg(F.sum(F.size("_keys")).alias("_n"), (F.min("_seq") - 1).alias("_first")))

    # names that are near enough, farther ones only for those with too few rows; a name's pair with itself is always there
    enough, own = F.sum("_n").over(Window.partitionBy(*name)) >= need, F.col("_text") == F.col("_other")
    pairs = names.select(*name, F.col("_text").alias("_other"), F.lit(0.0).alias("distance"), "_n", (F.col("_n") >= need).alias("_full"))
    for limit in (*[s for s in steps if s < at_most], at_most):
        open_ = pairs.where(own & ~F.col("_full")).select(*name)
        if open_.isEmpty():
            break
        found = near_names(open_, names.withColumnRenamed("_text", "_other"), on, "_text", "_other", limit).where(~own)
        found = found.join(names.select(*on, F.col("_text").alias("_other"), "_n"), [*on, "_other"]).select(*name, "_other", "distance", "_n")
        settled = pairs.where(own | F.col("_full")).drop("_full")
        pairs = kept(settled.unionByName(found).withColumn("_full", enough))
    of_name = Window.partitionBy(*name)
    up_to, level = F.sum("_n").over(of_name.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(Window.partitionBy(*name, "distance"))
    pairs = pairs.withColumn("_before", up_to - level).where(F.col("_before") < need).select(*name, "_other", "distance")

    # where each number stands among the near name's, and what stands around
    wanted = spots.select(*spot, F.col("_seq").alias("_from")).join(pairs, name)
    right = spots.select(*on, F.col("_text").alias("_other"), "_number", F.col("_seq").alias("_below"))
    placed = tenure.as_of(wanted.where(~own), right, [*on, "_other"], "_number", "_number", ["_below"]).select(*wanted.columns, "_below")
    placed = placed.join(names.select(*on, F.col("_text").alias("_other"), "_first"), [*on, "_other"]).withColumn("_below", F.coalesce("_below", "_first")).drop("_first")
    placed = wanted.where(own).withColumn("_below", F.col("_from")).unionByName(placed)  # a name knows its own places
    around = placed.withColumn("_seq", F.explode(F.sequence(F.col("_below") - need + 1, F.col("_below") + need))).drop("_below")
    there = spots.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col("_text").alias("_r_text"), F.col("_number").alias("_r_number"), "_keys", "_seq")
    near = around.join(there, "_seq").where(F.col("_other") == F.col("_r_text"))
    for c in on:
        near = near.where(F.col(c) == F.col(f"_r_{c}"))
    return near.select(*spot, "distance", F.abs(F.col("_number") - F.col("_r_number")).alias("gap"), F.explode("_keys").alias("other"))


def best_matches(rows: DataFrame, on: list[str], key: str, text: str, number: str, at_most: float = 0.6, keep: int = 5, steps: tuple[float, ...] = (0.3,)) -> DataFrame:
    """For each row its `keep` nearest other rows with equal `on`: key, other, distance, gap, place.

    Nearest by the names' normalised edit distance (up to at_most), then by the gap of
    their numbers, then by key, which must be unique.  What is ranked (`laid_out`) grows
    with the rows and not with their pairs.

    Rows with a null in key, on, text or number match nothing.  The numbers must cast to
    double.  An empty table gives no rows.
    """
    spot = [*on, "_text", "_number"]
    near = laid_out(rows, on, key, text, number, at_most, keep, steps)
    rank = F.row_number().over(Window.partitionBy(*spot).orderBy("distance", "gap", "other"))
    best = near.withColumn("_place", rank).where(F.col("_place") <= keep + 1).groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("distance", "gap", "other"))).alias("_best"))
    given = rows.select(*on, F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(number).cast("double").alias("_number")).dropna()
    others = F.slice(F.filter("_best", lambda x: x["other"] != F.col("_key")), 1, keep)
    return given.join(best, spot).select(F.col("_key").alias(key), F.posexplode(others).alias("place", "x")).select(key, "x.other", "x.distance", "x.gap", (F.col("place") + 1).alias("place"))
