"""Archives, splitting windows and keyed streams: stops, reruns and damaged files."""

import gzip
import hashlib
import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tandem.sources import archive, windows
from tandem.streaming import pairs


# -- archive -----------------------------------------------------------------


def _orders(spark, n=300):
    return spark.range(n).select(F.col("id").alias("order"), (F.col("id") % 3).alias("team"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string")).alias("day"), (F.col("id") * 1.5).alias("value"))


def _write(df, path):
    archive.write_windows(df, "team", "day", "day", path)


def test_manifest_digests_agree_with_the_files(spark, tmp_path):
    path = str(tmp_path / "a")
    assert archive.manifest(spark, path).count() == 0
    df = _orders(spark)
    _write(df, path)
    entries = archive.manifest(spark, path).collect()
    assert len(entries) == 21 and sum(e["n_rows"] for e in entries) == 300
    for e in entries:
        data = open(f"{path}/{e['path']}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == e["sha256"] and len(data) == e["n_bytes"]
        rows = json.loads(gzip.decompress(data))["rows"]
        assert {str(r["team"]) for r in rows} == {e["key"]} and len(rows) == e["n_rows"]
    before = open(f"{path}/manifest.jsonl").read()
    _write(df.repartition(7), path)  # the same rows give the same bytes
    assert open(f"{path}/manifest.jsonl").read() == before


def test_an_empty_result_or_a_failing_task_leaves_the_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    df = _orders(spark)
    _write(df, path)
    before = open(f"{path}/manifest.jsonl").read()
    _write(df.limit(0), path)
    assert open(f"{path}/manifest.jsonl").read() == before
    bad = df.withColumn("value", F.when(F.col("order") == 250, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value") + 1))
    with pytest.raises(Exception, match="lost"):
        _write(bad, path)
    assert open(f"{path}/manifest.jsonl").read() == before
    assert archive.revalidated(spark, path).where("state = 'reused'").count() == 21


def test_short_stale_and_damaged_windows_are_set_aside_and_read_again(spark, tmp_path):
    path = str(tmp_path / "a")
    df = _orders(spark)
    _write(df, path)
    entries = sorted(archive.manifest(spark, path).collect(), key=lambda e: (e["key"], e["from_date"]))
    short, stale, damaged, gone = entries[0], entries[4], entries[9], entries[12]

    def replaced(entry, change):
        payload = json.loads(gzip.decompress(open(f"{path}/{entry['path']}", "rb").read()))
        change(payload)
        data, digest = archive.packed(payload)
        open(f"{path}/{entry['path']}", "wb").write(data)
        return digest

    digests = {short["path"]: replaced(short, lambda p: p["rows"].pop()), stale["path"]: replaced(stale, lambda p: p.update(from_date="d9"))}
    lines = [json.loads(x) for x in open(f"{path}/manifest.jsonl")]
    with open(f"{path}/manifest.jsonl", "w") as out:
        out.writelines(json.dumps(x | {"sha256": digests.get(x["path"], x["sha256"])}) + "\n" for x in lines)
    open(f"{path}/{damaged['path']}", "ab").write(b"x")
    os.remove(f"{path}/{gone['path']}")
    checked = {(r["key"], r["from_date"]): r for r in archive.revalidated(spark, path).collect()}
    name = lambda e: (e["key"], e["from_date"])
    assert {k: r["reason"] for k, r in checked.items() if r["state"] == "discarded"} == {
        name(short): "row count mismatch", name(stale): "from_date mismatch", name(damaged): "digest mismatch", name(gone): "FileNotFoundError",
    }
    asked = []

    def again(todo):
        asked.extend(sorted((r["key"], r["from_date"]) for r in todo.collect()))
        return df.join(F.broadcast(todo.select(F.col("key").cast("long").alias("team"), F.col("from_date").alias("day"))), ["team", "day"], "left_semi").select(*df.columns)

    out = str(tmp_path / "combined")
    summary = archive.rebuilt(spark, path, out, df.schema, again, "team", "day", "day")
    assert asked == sorted(map(name, (short, stale, damaged, gone)))
    assert sorted(map(tuple, spark.read.parquet(out).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert {(r["state"], r["windows"], r["n_rows"]) for r in summary.collect()} == {("reused", 17, 300 - sum(e["n_rows"] for e in (short, stale, damaged, gone))), ("read again", 4, sum(e["n_rows"] for e in (short, stale, damaged, gone)))}
    assert archive.revalidated(spark, path).where("state = 'discarded'").count() == 0


# -- windows -----------------------------------------------------------------


def _send(cap):
    def send(url, parameters):
        """Four rows a day; an answer is cut off at the cap; what holds the ninth is never answered."""
        a, b = date.fromisoformat(parameters["from"]), date.fromisoformat(parameters["to"])
        if a <= date(2024, 1, 9) <= b and parameters["key"] == "a":
            return 503, None
        rows = [{"day": (a + timedelta(days=i)).isoformat(), "n": j} for i in range((b - a).days + 1) for j in range(4 if parameters["key"] == "a" else 1)]
        return 200, json.dumps(rows[:cap])

    return send


def _land(spark, tmp_path, name, stop_after=None):
    cap = 12
    spark.dataSource.register(windows.splitting_source(name, _send(cap)))
    given = [("a", *w) for w in windows.tumbling("2024-01-01", "2024-01-20")] + [("b", "2024-01-01", "2024-01-05")]
    stream = spark.readStream.format(name).options(windows=json.dumps(given), state=str(tmp_path / "state"), cap=str(cap), attempts="2", pause="0").load()

    def each(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/landed/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    if stop_after is None:
        query.processAllAvailable()
    else:
        while query.lastProgress is None or query.lastProgress["batchId"] < stop_after:
            assert query.isActive, query.exception()
    query.stop()
    return spark.read.parquet(str(tmp_path / "landed")).collect() if stop_after is None else None


def _judge(rows):
    landed = [(r["key"], json.loads(r["row"])["day"], json.loads(r["row"])["n"]) for r in rows if r["kind"] == "row"]
    days = [(date(2024, 1, 1) + timedelta(days=i)).isoformat() for i in range(20)]
    want = [("a", d, n) for d in days if d != "2024-01-09" for n in range(4)] + [("b", d, 0) for d in days[:5]]
    assert sorted(landed) == sorted(want)  # every row once
    tries = [r for r in rows if r["kind"] == "try"]
    seen = [r for r in rows if r["kind"] == "window"]
    assert sum(r["attempt"] for r in seen) == len(tries)
    failed = [(r["from_date"], r["status"]) for r in seen if r["status"] == "failed"]
    assert failed == [("2024-01-09", "failed")]
    assert len([r for r in tries if r["from_date"] == r["to_date"] == "2024-01-09"]) == 2
    assert {r["depth"] for r in seen} == {0, 1, 2, 3, 4} and all(r["n_rows"] < 12 for r in seen if r["status"] == "success")


def test_refused_windows_split_into_the_next_batch(spark, tmp_path):
    _judge(_land(spark, tmp_path, "windows_once"))


def test_a_stopped_run_of_windows_resumes(spark, tmp_path):
    _land(spark, tmp_path, "windows_twice", stop_after=1)
    _judge(_land(spark, tmp_path, "windows_twice"))


def test_tumbling_windows_are_clipped():
    assert windows.tumbling("2024-01-01", "2024-01-20") == [("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-20")]
    assert windows.halves("2024-01-01", "2024-01-04") == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04")]


# -- pair documents ----------------------------------------------------------


def _result(i, focal, metrics, reason=None, team=1):
    return (2024, team, focal, datetime(2024, 1, 1) + timedelta(minutes=i), i, metrics, reason)


ROUNDS = [
    [_result(i, 7, None, f"status {i}") for i in range(150)] + [_result(151, 8, 0)],
    [_result(200, 7, 12), _result(201, 8, 5), _result(202, 9, None, "timeout", team=2)],
    [_result(300, 7, None, "late"), _result(301, 9, 3, team=2), _result(302, 5, None, "gone", team=3)],
]


def _run(spark, tmp_path, name, rounds):
    source, out = tmp_path / name / "in", str(tmp_path / name / "out")
    os.makedirs(source, exist_ok=True)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pairs.STORE)
    try:
        for i in rounds:
            spark.createDataFrame(ROUNDS[i], pairs.RESULT).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(pairs.RESULT).parquet(str(source))
        query = pairs.land_updates(stream, out, str(tmp_path / name / "checkpoint"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return pairs.latest(spark.read.parquet(out))


def test_pair_documents_resume_and_bound_their_errors(spark, tmp_path):
    once = _run(spark, tmp_path, "once", [0, 1, 2])
    for i in range(3):  # stopped and started again after every round
        several = _run(spark, tmp_path, "several", [i])
    key = lambda r: r["focal"]
    assert sorted(once.collect(), key=key) == sorted(several.collect(), key=key)
    seven = next(r for r in several.collect() if r["focal"] == 7)
    assert (seven["complete"], seven["tries"], seven["metrics"]) == (True, 151, 12)  # what came later is not counted
    assert [e["reason"] for e in seven["errors"]] == [f"status {i}" for i in range(50, 150)]
    expected = spark.createDataFrame([(2024, 1, 7), (2024, 1, 8), (2024, 2, 9), (2024, 2, 10), (2024, 3, 5)], "season int, team int, focal long")
    core = spark.createDataFrame([(2024, 1, True, False), (2024, 2, True, False), (2024, 3, False, False), (2024, 4, True, True)], "season int, team int, complete boolean, absent boolean")
    got = {r["team"]: tuple(r)[2:] for r in pairs.documents(several, expected, core).collect()}
    assert got == {
        1: ("complete", True, 2, 2, 153, 100, "no metric results"), 2: ("partial", False, 2, 1, 2, 1, "timeout"), 3: ("error", False, 0, 0, 0, 0, None), 4: ("absent", True, 0, 0, 0, 0, None),
    }
