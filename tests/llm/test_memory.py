"""What the Python steps hold at once, beside batches of bounded size."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.llm import common, ngram_join, piece_lattice, quality_rules, queries, secrets


@pytest.fixture
def setting(spark):
    old = spark.conf.get(common.BATCH_SETTING)
    yield common.BATCH_SETTING
    spark.conf.set(common.BATCH_SETTING, old)


def peak_mb(f):
    f()  # tables that are made once
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def texts(n_bytes, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    return [" ".join(rng.choices(words, k=600)) for _ in range(n_bytes // 3900)]


@pytest.mark.parametrize("step", ["quality rules", "n-gram join", "secrets", "pieces", "round trip"])
def test_batches_to_python_are_bounded(spark, setting, step):
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some word "), 400).alias("text"))
    few = docs.limit(20)
    spark.conf.set(setting, "64m")
    path = queries.tokenizer_file(queries.PIECE_MODEL)
    if step == "quality rules":
        quality_rules.keep_good(few, few.select("doc_id", F.lit(1).alias("quality")))
    elif step == "n-gram join":
        ngram_join.one_of_each(few)
    else:
        {"secrets": secrets.redact, "pieces": lambda d: piece_lattice.encode(d, path), "round trip": lambda d: piece_lattice.round_trip(d, path)}[step](few)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = docs.select("text").mapInArrow(sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
    assert got[0] == 6000 and got[1] <= common.BATCH_BYTES + (64 << 10)


@pytest.mark.parametrize("given, kept", [("67108864b", None), ("16m", None), ("1g", None), ("3m", "3m"), ("512k", "512k"), ("1000", "1000")])
def test_a_lower_setting_stays(spark, setting, given, kept):
    spark.conf.set(setting, given)
    common.small_batches(spark)
    assert spark.conf.get(setting) == (kept or str(common.BATCH_BYTES))


def test_counts_and_signatures_hold_slices_only():
    some = pa.array(texts(8 << 20), pa.string())
    assert peak_mb(lambda: quality_rules.measure.func(some)) < 80
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64())] * 2 + [some], ["doc_id", "mark", "text"])
    assert peak_mb(lambda: [None for _ in ngram_join._signatures(20, 5, 5)(iter([batch]))]) < 45
    assert peak_mb(lambda: [None for _ in ngram_join._texts_to_sets(5)(iter([batch]))]) < 45


def test_slices_do_not_change_counts(monkeypatch):
    some = pa.array([*texts(300_000), None, "", "x"], pa.string())
    want = quality_rules.measure.func(some)
    for limit in (1, 10_000, 4 << 20):
        monkeypatch.setattr(common, "SPAN_BYTES", limit)
        assert quality_rules.measure.func(some).equals(want)


def test_a_repeated_pretoken_is_held_once():
    run, some = piece_lattice.Encoder(queries.tokenizer_file(queries.PIECE_MODEL)), texts(4 << 20)
    assert peak_mb(lambda: run(some)) < 28
