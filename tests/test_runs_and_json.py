"""Runs of integers and JSON walks, held against plain versions."""

import itertools
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tandem.operators import runs, variants


def _runs(numbers):
    out = []
    for x in sorted(set(numbers)):
        if out and x <= out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


def test_career_sums_reach_what_brute_force_reaches(spark):
    random.seed(7)
    rows = []
    for brand in range(12):
        for _ in range(random.randint(1, 5)):
            kind = random.random()
            lo = random.randint(0, 30)
            numbers = list(range(lo, lo + random.randint(1, 4))) if kind < 0.5 else random.sample(range(60), random.randint(1, 4)) if kind < 0.9 else []
            rows.append((brand, random.sample(numbers, len(numbers))))
    rows += [(50, []), (51, None), (52, [3, None, 3])]
    sets = spark.createDataFrame(rows, "brand int, numbers array<bigint>").withColumn("runs", runs.runs_of(F.col("numbers")))
    assert all([tuple(r) for r in s["runs"] or []] == _runs(x for x in s["numbers"] or [] if x is not None) for s in sets.collect())
    want = {}
    for brand in {b for b, n in rows if n}:
        want[brand] = {sum(c) for c in itertools.product(*[[x for x in n if x is not None] for b, n in rows if b == brand and n])}
    for fan in (1, 64):
        got = runs.career_sums(sets, ["brand"], "runs", fan).withColumn("n", runs.size(F.col("totals"))).collect()
        assert {r["brand"]: [tuple(x) for x in r["totals"]] for r in got} == {b: _runs(s) for b, s in want.items()}
        assert {r["brand"]: r["n"] for r in got} == {b: len(s) for b, s in want.items()}


def test_a_wide_set_is_one_run(spark):
    sets = spark.range(1000).select(F.lit(1).alias("k"), F.array(F.struct(F.col("id").alias("lo"), (F.col("id") + 10**9).alias("hi"))).alias("runs"))
    got = runs.career_sums(sets, ["k"], "runs").first()
    assert [tuple(r) for r in got["totals"]] == [(499500, 499500 + 10**12)]


def _walk(text):
    try:
        todo = [("$", json.loads(text))]
    except (TypeError, ValueError):
        return
    while todo:
        path, x = todo.pop()
        kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else type(x).__name__
        yield path, kind, None if isinstance(x, dict | list) or x is None else json.dumps(x, ensure_ascii=False)
        todo += [(f"{path}.{k}", v) for k, v in x.items()] if isinstance(x, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(x)] if isinstance(x, list) else []


made_row = Row("id", "path", "kind", "value")


def test_walk_gives_every_level(spark):
    texts = [
        '{"a": {"b": [1, 2.5, {"c": null}], "d": "x\\"y"}, "e": true}', "[]", "{}", "[[[[7]]]]", "null", '"s"', "3", "-0.25", "", None, "{bad", '{"k": 5, "empty": {}, "é": "ü", "big": 9007199254740993}', '[{"a": 1}, {"a": [false]}]',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, text string").withColumn("v", F.lit(0))
    out = variants.walk(rows, "text", ["v"]).limit(1).columns
    assert out == ["v", "path", "kind", "value"]
    rows = rows.withColumnRenamed("path", "id")
    made = variants.walk(rows, "text", ["id"])
    plain = [(i, *w) for i, t in enumerate(texts) for w in _walk(t)]
    assert sorted(made.collect(), key=str) == sorted([made_row(*w) for w in plain], key=str)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    deep = spark.createDataFrame([(1, "[" * 40 + "1" + "]" * 40)], "id int, text string")
    assert variants.walk(deep, "text", ["id"]).count() == 41
    assert variants.walk(deep.limit(0), "text", ["id"]).count() == 0
