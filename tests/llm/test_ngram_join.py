import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import common, ngram_join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = dict.fromkeys(range(len(rows)), 0)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 10 * len(x & y) >= 10 * threshold * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted((rows[k][0], least[find(k)], links[k]) for k in range(len(rows)))


def rows_of(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect())


def varied(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.integers(len(out))] = f"w{rng.integers(10**6)}"
    return " ".join(out)


def corpus(seed=3, n_base=12, copies=9):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(n_base):
        base = [f"t{b}_{rng.integers(400)}" for _ in range(int(rng.integers(30, 120)))]
        rows += [varied(rng, base, k % 5) for k in range(copies)]
    rows += ["", None, "one two", "one two", "a b c d e", "a b c d e f"]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i]) for i in order]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9995)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.near_classes(docs)) == brute(rows)


def test_blocks_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"q{k}" for k in range(100)]
    rows = [(k, varied(rng, base, 1 + k % 2)) for k in range(120)] + [(1000 + k, " ".join(base)) for k in range(7)]
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.near_classes(docs)) == brute(rows)


def test_ids_of_several_texts(spark):
    words = [f"v{k}" for k in range(60)]
    a, b, near = " ".join(f"u{k}" for k in range(60)), " ".join(words), " ".join([*words[:59], "other"])
    rng = np.random.default_rng(8)
    for _ in range(2):
        rows = [(2, a), (2, b), (7, b), (8, near), (9, a), (4, near), (4, a), (4, a)]
        rows = [rows[i] for i in rng.permutation(len(rows))]
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
        assert rows_of(ngram_join.near_classes(docs)) == brute(rows)
        # each of the two classes keeps the text of its smallest id
        assert sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()) == sorted([(2, a), (2, b)])
    both = [(1, b), (1, near), (1, b), (3, near), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(both)], "doc_id long, text string, k int")
    kept = {tuple(sorted((r["doc_id"], r["text"] is None) for r in ngram_join.one_of_each(docs.repartition(n)).collect())) for n in (1, 3)}
    assert kept == {((1, False), (5, True), (5, True))}
    assert len({ngram_join.one_of_each(docs.repartition(n)).where("doc_id = 1").first()["k"] for n in (1, 2, 5)}) == 1


@pytest.mark.parametrize("shares", [4, 4096])
def test_hot_keys_meet_by_broadcast(spark, monkeypatch, shares):
    monkeypatch.setattr(common, "SHARES", shares)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(15)
    base = [f"h{k}" for k in range(80)]
    rows = [(k, varied(rng, base, k % 3)) for k in range(60)] + [(500 + k, " ".join(base)) for k in range(40)] + corpus(4, 3, 4)[:12] + [(900 + k, f"alone{k} in the world") for k in range(30)]
    assert rows_of(ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def shuffled(spark):
    """Bytes shuffled so far, by the stages that Spark still knows."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("query", [ngram_join.near_classes, ngram_join.one_of_each])
def test_texts_without_partners_are_not_shuffled(spark, query):
    rng = np.random.default_rng(21)
    rows = [(k, " ".join(f"{x:x}" for x in rng.integers(1 << 40, size=1500))) for k in range(300)]
    rows += [(1000 + k, varied(rng, rows[0][1].split(), 20)) for k in range(5)] + [(2000, rows[1][1])] * 2
    docs = common.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables of keys are large
    try:
        before = shuffled(spark)
        got = query(docs).collect()
        moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute(rows)
    if query is ngram_join.one_of_each:
        assert sorted(r["doc_id"] for r in got) == sorted({c for _, c, _ in want})
    else:
        assert sorted(tuple(r) for r in got) == want
    assert moved < 0.2 * sum(len(t) for _, t in rows), moved


@pytest.mark.parametrize("most_bits", [1 << 15, 1 << 27])
def test_sift_keeps_every_match(spark, monkeypatch, most_bits):
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    rows = spark.range(200_000).selectExpr("if(id % 50 = 7, null, id) a", "id % 3 b", "'x' part")
    table = spark.range(0, 200_000, 20).selectExpr("id a", "id % 3 b")
    some = common.sift(rows, table, "a", "b")
    assert some.columns == rows.columns and some.join(table, ["a", "b"]).count() == 10_000
    assert most_bits < 1 << 20 or some.count() < 15_000
    assert common.sift(rows, table.limit(0), "a", "b").count() == 0
    assert common.flagged(rows, table, "flag", "a", "b").count() == 200_000


def test_blocks_grow_before_they_become_many(spark):
    sizes = [(2, 800), (400, 160_000), (3_000, 300_000), (20_000, 400_000), (36_000, 14_400_000)]
    got = spark.createDataFrame(sizes, "members long, total long").select(ngram_join._blocks(F.col("members"), F.col("total"))).collect()
    assert [r[0] for r in got] == [1, 3, 8, 8, 10]


def test_larger_blocks_are_compared_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"q{k}" for k in range(100)]
    rows = [(k, varied(rng, base, 1 + k % 3)) for k in range(90)] + [(1000 + k, " ".join(base)) for k in range(7)]
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for blocks in (1, 2):
        monkeypatch.setattr(ngram_join, "BLOCKS", blocks)
        assert rows_of(ngram_join.near_classes(docs)) == brute(rows)


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARES", 3)
    rng = np.random.default_rng(2)
    chain, star = [(k, k + 1) for k in range(40)], [(100, 101 + k) for k in range(50)]
    more = [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    edges = chain + star + more
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_recall_on_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows_of(ngram_join.near_classes(docs)) == brute([tuple(r) for r in docs.collect()])


def test_edges(spark):
    schema = "doc_id long, text string, rep string, n string, digest string"
    rows = [(None, "a b c d e f", "x", None, None), (2, "a b c d e f", None, "y", "z"), (2, "a b c d e f", None, "y", "z"), (3, None, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_classes(docs).collect()}
    assert got == {(None, None, 0), (2, 2, 1), (3, 3, 0)}
    assert sorted((r["doc_id"] or 0) for r in ngram_join.one_of_each(docs).collect()) == [0, 2, 3]
    assert ngram_join.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_intersections(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(40)]
    got = ngram_join.intersections(sets[:25], sets[25:])
    assert (got == np.array([[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]])).all()
