"""URL filters with history: every capture is judged by the list entries active when it was fetched.

A list is a log of dated entries (scope, pattern, action, listed_at): scope is
``domain`` (a host and all below it), ``host`` (one host), ``prefix`` (host and
leading path segments) or ``url`` (the whole normalised URL); action is ``block``,
``allow`` or ``remove``.  ``intervals`` turns the log into validity intervals: an
entry holds until the next one of its scope and pattern.

``judge`` gives each capture the keys that could be listed (its host's suffixes,
its path's prefixes, its URL) and joins them with the intervals as of the fetch
time.  The narrowest entry decides: url, then the longest prefix, then host, then
the longest domain; at equal width allow wins.

Keys are counted first, by partial sums.  Of those that a large share of all captures
asks for (fewer than common.SHARES), the unlisted ones go before anything is dealt by
key, and the listed ones are salted: their captures spread over SALTS tasks, and their
intervals are repeated.  Key and interval rows grow with captures and with the list,
never with their product: a key has one active interval at a time.

Main path: DataFrame functions only.

Defined edge cases: a null or unparsable URL has no host and is kept, with status
``invalid``; a null fetch time is judged by the latest entries; entries with a
null field are ignored; of entries of one scope, pattern and time the order
remove, block, allow decides (the last holds); a final slash or dot of a pattern
does not count.  Repeated captures each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import common

#: Salts, for each shuffle partition, that all asked keys together would have; a hot key has its share of them.
SALTS = 4
_FAR = "9999-12-31"


def url_parts(url: Column) -> dict[str, Column]:
    """host (lower case, without user, port and final dot), path without query, fragment and final slash, and the URL made of both."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"\.$", "")
    path = F.regexp_replace(F.regexp_extract(url, pattern, 2), "/+$", "")
    return {"host": host, "path": path, "whole": F.concat(host, path)}


def intervals(entries: DataFrame) -> DataFrame:
    """(key, scope, action, valid_from, valid_to) of the block and allow entries of a dated list."""
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "block", 1).otherwise(2)
    bare = F.regexp_replace(F.lower(F.trim("pattern")), F.when(F.col("scope").isin("prefix", "url"), "/+$").otherwise(r"\.+$"), F.lit(""))
    log = entries.select("scope", bare.alias("pattern"), "action", F.col("listed_at").cast("timestamp_ntz").alias("valid_from")).dropna()
    log = log.groupBy("scope", "pattern", "valid_from").agg(F.max_by("action", rank).alias("action"))
    until = F.lead("valid_from").over(Window.partitionBy("scope", "pattern").orderBy("valid_from"))
    spans = log.withColumn("valid_to", F.coalesce(until, F.lit(_FAR).cast("timestamp_ntz"))).where("action <> 'remove'")
    return spans.select(F.concat_ws(":", "scope", "pattern").alias("key"), "scope", "action", "valid_from", "valid_to")


def keys_of(host: Column, path: Column, whole: Column, deepest: int | None) -> Column:
    """All keys that could be listed for a URL, each with its width: array<struct<key, width>>.

    deepest is the greatest number of path segments of any listed prefix, None without one.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, n - i + 1, i), ".")).alias("key"), i.alias("width")))
    own = F.array(F.struct(F.concat(F.lit("host:"), host).alias("key"), F.lit(1000).alias("width")), F.struct(F.concat(F.lit("url:"), F.lower(whole)).alias("key"), F.lit(1 << 30).alias("width")))
    if deepest is None:
        return F.concat(suffixes, own)
    segments = F.split(F.lower(path), "/")
    lead = lambda i: F.struct(F.concat(F.lit("prefix:"), host, F.array_join(F.slice(segments, 1, i + 1), "/")).alias("key"), (i + 2001).alias("width"))
    return F.concat(suffixes, F.transform(F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(deepest))), lead), own)


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: page_id, host, fetched_at, status (kept, allowed, blocked, invalid) and the deciding key."""
    parts = url_parts(F.col("url"))
    base = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp_ntz").alias("fetched_at"))
    base = base.select("page_id", "fetched_at", *[F.coalesce(c, F.lit("")).alias(k) for k, c in parts.items()])
    row = F.monotonically_increasing_id()
    table = common.cut(base.withColumn("row", row))
    spans = common.cut(intervals(entries))
    deepest = spans.where("scope = 'prefix'").agg(F.max(F.size(F.split("key", "/")) - 1).alias("n")).first()["n"]
    at = F.coalesce("fetched_at", F.lit("9999-12-30").cast("timestamp_ntz"))
    asked = table.where("host <> ''").select("row", at.alias("at"), F.explode(keys_of(F.col("host"), F.col("path"), F.col("whole"), deepest)).alias("k")).select("row", "at", "k.key", "k.width")
    counts = common.cut(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    listed = spans.select("key").distinct().withColumn("listed", F.lit(True))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(1.0, total / (SALTS * int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shared = common.share_of(counts, "key", total=total).join(counts, "key").join(listed, "key", "left")
    hot = shared.select("key", F.coalesce("listed", F.lit(False)).alias("listed"), F.ceil(F.col("n") / size).cast("int").alias("salts"))
    hot = F.broadcast(hot)
    salted_spans = spans.join(hot.drop("listed"), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    salted = asked.join(hot, "key", "left").where("coalesce(listed, true)").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).otherwise(F.lit(0)))
    met = salted.join(salted_spans.select("key", "salt", "action", "valid_from", "valid_to"), ["key", "salt"]).where("valid_from <= at and at < valid_to")
    best = F.max(F.struct(F.col("width"), (F.col("action") == "allow").cast("int").alias("allow"), F.col("key"), F.col("action")))
    verdict = met.groupBy("row").agg(best.alias("v"))
    status = F.when(F.col("host") == "", "invalid").when(F.col("v.action") == "block", "blocked").when(F.col("v.action") == "allow", "allowed").otherwise("kept")
    return table.join(verdict, "row", "left").select("page_id", "host", "fetched_at", status.alias("status"), F.col("v.key").alias("entry"))
