"""Row numbers and as-of joins over ranges and buckets, held against plain versions."""

import bisect
import random

from pyspark.sql import functions as F

from tandem.operators import ranking, tenure


def test_numbered_is_the_sorted_order(spark):
    random.seed(3)
    rows = [(i, random.choice([None, 1.0, 2.5, -3.0]), "x" * (i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double, n string").repartition(7)
    got = {r["id"]: r["place"] for r in ranking.numbered(df, [F.desc_nulls_last("v"), F.asc("id")], "place", parts=5).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}
    assert ranking.numbered(df.limit(0), [F.asc("id")], "place").count() == 0
    assert ranking.numbered(df, [F.asc("id")], "n").agg(F.max("n")).first()[0] == 499  # a column of that name is replaced


def test_no_window_sees_the_whole_table(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    out = ranking.places(df, {"a": [F.desc("v"), F.asc("id")], "b": [F.asc("id")]})
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r["a"] for r in rows) == list(range(1, 101))
    assert all(r["b"] == r["id"] + 1 for r in rows)
    ranked = ranking.rank_qualified(df, F.when(F.col("v") != 3, F.col("v") > 1), [F.desc("v"), F.asc("id")])
    kept = sorted((r for r in ranked.collect() if r["rank"]), key=lambda r: r["rank"])
    assert [r["id"] for r in kept] == [r["id"] for r in sorted(kept, key=lambda r: (-r["v"], r["id"]))]
    assert all(r["v"] > 1 and r["v"] != 3 for r in kept) and len(kept) == len([i for i in range(100) if i % 7 > 1 and i % 7 != 3])


def _plain(left, right, forward, strict):
    out = {}
    for i, k, t in left:
        times = sorted((a, v) for v, kk, a in right if kk == k and a is not None and k is not None)
        if t is None or not times:
            out[i] = None
        elif forward:
            at = (bisect.bisect_right if strict else bisect.bisect_left)([a for a, _ in times], t)
            out[i] = times[at][1] if at < len(times) else None
        else:
            at = (bisect.bisect_left if strict else bisect.bisect_right)([a for a, _ in times], t)
            out[i] = times[at - 1][1] if at else None
    return out


def test_as_of_over_buckets_equals_the_plain_one(spark):
    random.seed(5)
    draw = lambda n, base: [(base + i, random.choice([1, 1, 1, 2, 3, None]), random.choice([None, *range(40)])) for i in range(n)]
    left, right = draw(300, 0), draw(90, 1000)
    le = spark.createDataFrame(left, "id int, k int, t int")
    ri = spark.createDataFrame(right, "other int, k int, t int")
    for forward in (False, True):
        for strict in (False, True):
            for buckets in (1, 16):
                got = tenure.as_of(le, ri, "k", "t", "t", ["other"], forward=forward, strict=strict, buckets=buckets).collect()
                assert len(got) == 300
                assert {r["id"]: r["other"] for r in got} == _plain(left, right, forward, strict)
    assert {r["other"] for r in tenure.as_of(le, ri.limit(0), "k", "t", "t", ["other"]).collect()} == {None}


def test_as_of_spreads_a_user_with_a_third_of_the_events(spark):
    n, parts = 6000, 8
    user = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997)
    events = spark.range(n).select("id", user.alias("k"), F.timestamp_seconds(F.col("id") * 37).alias("t"))
    left, right = events.where("id % 2 = 0"), events.where("id % 2 = 1").withColumnRenamed("id", "other")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in tenure.as_of(left, right, "k", "t", "t", ["other"], buckets=256).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n // 2 and max(sizes) <= 2 * n / 2 / parts
