"""The best few matches by edit distance, held against all pairs."""

import random

from pyspark.sql import functions as F

from tandem.operators import matching


def _distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(last + (x != y), line[j] + 1, line[j - 1] + 1)
    return line[-1]


def _rows(n, seed, names=None):
    random.seed(seed)
    syllables = ["an", "na", "ba", "bo", "lt", "ri", "ng", "a", "x"]
    make = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 5)))
    pool = [make() for _ in range(names)] if names else None
    rows = [(i, random.choice("pq"), random.choice(pool) if pool else make(), random.choice([1, 1, 2, 5, 9, 40])) for i in range(n)]
    return rows + [(n, "p", None, 1), (n + 1, None, "anna", 1), (n + 2, "q", "anna", None), (n + 3, "q", "", 3), (n + 4, "q", "", 4)]


def _plain(rows, at_most, keep):
    out = []
    for i, brand, name, size in rows:
        if brand is None or name is None or size is None:
            continue
        found = []
        for j, b, other, s in rows:
            if j == i or b != brand or other is None or s is None:
                continue
            d = 0.0 if name == other else _distance(name, other) / max(len(name), len(other))
            if d <= at_most:
                found.append((d, abs(size - s), j))
        out += [(i, j, round(d, 9), gap, k + 1) for k, (d, gap, j) in enumerate(sorted(found)[:keep])]
    return sorted(out)


def test_best_matches_equal_all_pairs(spark):
    for rows, at_most, keep in ((_rows(150, 1), 0.6, 5), (_rows(150, 2, names=6), 0.6, 5), (_rows(90, 3), 0.2, 2)):
        df = spark.createDataFrame(rows, "id long, brand string, name string, size int").withColumn("distance", F.lit("clash"))
        got = sorted((r["id"], r["other"], round(r["distance"], 9), r["gap"], r["place"]) for r in matching.best_matches(df, ["brand"], "id", "name", "size", at_most, keep).collect())
        assert got == _plain(rows, at_most, keep)
    assert matching.best_matches(df.limit(0), ["brand"], "id", "name", "size").count() == 0


def test_near_names_lose_no_pair(spark):
    random.seed(11)
    names = list({"".join(random.choice("abcd") for _ in range(random.randint(1, 14))) for _ in range(160)})
    df = spark.createDataFrame([(n, 1) for n in names], "name string, k int")
    for at_most in (0.1, 0.2, 0.3, 0.45, 0.6):
        got = {(r["name"], r["other"]) for r in matching.near_names(df, df.withColumnRenamed("name", "other"), ["k"], "name", "other", at_most).collect()}
        assert got == {(a, b) for a in names for b in names if _distance(a, b) <= at_most * max(len(a), len(b)) + 1e-12}


def test_rows_before_ranking_grow_with_the_rows(spark):
    """Twice the rows of the same names: what is ranked grows twofold and not fourfold."""
    made = []
    for n in (400, 800):
        df = spark.createDataFrame(_rows(n, 5, names=8), "id long, brand string, name string, size int").withColumn("size", F.col("id") % 97)
        made.append(matching.laid_out(df, ["brand"], "id", "name", "size").count())
    assert made[1] <= 2.2 * made[0]
