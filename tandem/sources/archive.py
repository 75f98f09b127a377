"""An archive of windows: content-named files written by tasks, and a manifest that a commit makes valid.

`window_archive` is a Spark data source for writing: each task puts the rows of a
(key, from_date, to_date) into a gzip JSON file named by its SHA-256, beside nothing
that a reader looks at.  Only the driver's commit replaces the manifest, in one rename.
A task that fails or an attempt that is repeated leaves files without an entry and the
old archive as it was; so does a write without rows.

Rows must come sorted by window inside a partition (`write_windows` sees to it), so a task
holds one window at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tandem.sources.scratch import kept

WINDOW = ("key", "from_date", "to_date")
MANIFEST = "key string, from_date string, to_date string, path string, sha256 string, n_rows long, n_bytes long"


@dataclass
class _Written(WriterCommitMessage):
    entries: list


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path; a bare path is a local or mounted one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def packed(payload: dict) -> tuple[bytes, str]:
    """A payload as gzip JSON and the digest of those bytes; equal payloads give equal bytes."""
    data = gzip.compress(json.dumps(payload, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode(), mtime=0)
    return data, hashlib.sha256(data).hexdigest()


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(f"{root}/windows", recursive=True)
        entries, now, rows = [], None, []

        def close():
            if now is None:
                return
            data, digest = packed({"key": now[0], "from_date": now[1], "to_date": now[2], "rows": rows})
            name = f"windows/{digest}.json.gz"
            temporary = f"{root}/windows/.{digest}.{id(rows)}"
            with store.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            store.move(temporary, f"{root}/{name}")  # the same bytes may be there from an earlier attempt
            entries.append([*now, name, digest, len(rows), len(data)])

        for r in iterator:
            window = tuple(r[c] for c in WINDOW)
            if window != now:
                close()
                now, rows = window, []
            rows.append(json.loads(r["row"]))
        close()
        return _Written(entries)

    def commit(self, messages: list) -> None:
        entries = [e for m in messages if m is not None for e in m.entries]
        if not entries:
            return  # an empty result never replaces an archive
        windows = [tuple(e[:3]) for e in entries]
        if len(set(windows)) != len(windows):
            raise ValueError("rows of one window came from two tasks")
        store, root = _store(self.path)
        text = "".join(json.dumps(dict(zip((*WINDOW, "path", "sha256", "n_rows", "n_bytes"), e, strict=True)), sort_keys=True) + "\n" for e in sorted(entries, key=str))
        with store.open_output_stream(f"{root}/.manifest.tmp", compression=None) as out:
            out.write(text.encode())
        store.move(f"{root}/.manifest.tmp", f"{root}/manifest.jsonl")

    def abort(self, messages: list) -> None:
        """Files without an entry are no part of the archive; the manifest stays as it was."""


class WindowArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "window_archive"

    def schema(self) -> str:
        return "key string, from_date string, to_date string, row string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_windows(rows: DataFrame, key: str, from_date: str, to_date: str, path: str) -> None:
    """Archives rows by window: one file and one manifest entry each, digests of the files' bytes in the manifest.

    A window's rows are one document and go through one task, in the order of their JSON
    text.  A null in the window's columns is written as an empty text.
    """
    rows.sparkSession.dataSource.register(WindowArchive)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip((key, from_date, to_date), WINDOW, strict=True)]
    flat = rows.select(*names, F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("row"))
    flat.repartition(*WINDOW).sortWithinPartitions(*WINDOW, "row").write.format("window_archive").option("path", path).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The archive's entries; none before the first commit."""
    store, root = _store(path)
    if store.get_file_info(f"{root}/manifest.jsonl").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest.jsonl")


#: What a file must hold to be admitted again.
CHECKED = "key string, from_date string, to_date string, state string, reason string, rows array<string>"


def _admit(path: str):
    store, root = _store(path)

    def read(entry: dict) -> tuple[str, str, list | None]:
        try:
            with store.open_input_stream(f"{root}/{entry['path']}", compression=None) as given:
                data = given.read()
            if hashlib.sha256(data).hexdigest() != entry["sha256"]:
                return "discarded", "digest mismatch", None
            payload = json.loads(gzip.decompress(data))
        except (OSError, EOFError, ValueError) as e:
            return "discarded", type(e).__name__, None
        for field in WINDOW:
            if not isinstance(payload, dict) or payload.get(field) != entry[field]:
                return "discarded", f"{field} mismatch", None
        rows = payload.get("rows")
        if not isinstance(rows, list) or len(rows) != entry["n_rows"]:
            return "discarded", "row count mismatch", None
        return "reused", "", [json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():  # a window at a time
                state, reason, rows = read(entry)
                columns = [[entry[c]] for c in WINDOW] + [[state], [reason]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array([rows], pa.list_(pa.string()))], [*WINDOW, "state", "reason", "rows"])

    return run


def revalidated(spark: SparkSession, path: str) -> DataFrame:
    """Every entry read again: its digest, window and row count must agree with its file, else it is discarded with the reason."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, for entries are small and their files are not
    return manifest(spark, path).repartition(parts, *WINDOW).mapInArrow(_admit(path), CHECKED)


def rebuilt(spark: SparkSession, path: str, out: str, schema: StructType, again: Callable[[DataFrame], DataFrame], key: str, from_date: str, to_date: str) -> DataFrame:
    """The combined table under `out` from all windows of an archive; (state, windows, n_rows) of what went into it.

    Windows that are admitted give their rows.  The others are handed to `again` as
    (key, from_date, to_date, reason); what it returns is archived beside the valid
    entries and read back under the same gate.  The table is partitioned by key and
    only the partitions at hand are overwritten, so others there stay.
    """
    checked = kept(revalidated(spark, path))
    todo = checked.where("state = 'discarded'").select(*WINDOW, "reason")
    parse = lambda df, state: df.where("state = 'reused'").select(*WINDOW, F.lit(state).alias("state"), F.explode("rows").alias("row"))
    rows = parse(checked, "reused")
    if not todo.isEmpty():
        redo = f"{path}/again"
        write_windows(again(todo), key, from_date, to_date, redo)
        _adopt(path, redo, [tuple(r) for r in todo.select(*WINDOW).collect()])
        fresh = revalidated(spark, path).join(F.broadcast(todo.select(*WINDOW)), list(WINDOW), "left_semi")
        rows = rows.unionByName(parse(fresh, "read again"))
    parsed = kept(rows.select("key", "from_date", "state", F.from_json("row", schema).alias("r"))).withColumnRenamed("key", "_window_key")
    made = parsed.select("_window_key", "r.*")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_window_key").parquet(out)
    return parsed.groupBy("state").agg(F.count_distinct("_window_key", "from_date").alias("windows"), F.count(F.lit(1)).alias("n_rows"))


def _adopt(path: str, redo: str, windows: list[tuple]) -> None:
    """Takes the entries of windows read again into the manifest in one rename; those that did not come keep no entry."""
    store, root = _store(path)
    _, other = _store(redo)
    load = lambda at: [json.loads(x) for x in store.open_input_stream(f"{at}/manifest.jsonl", compression=None).read().decode().splitlines()]
    bad = set(windows)
    entries = [e for e in load(root) if tuple(e[c] for c in WINDOW) not in bad]
    for e in load(other) if store.get_file_info(f"{other}/manifest.jsonl").type != pafs.FileType.NotFound else []:
        store.move(f"{other}/{e['path']}", f"{root}/{e['path']}")
        entries.append(e)
    with store.open_output_stream(f"{root}/.manifest.tmp", compression=None) as out:
        out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in sorted(entries, key=lambda e: [e[c] for c in WINDOW])).encode())
    store.move(f"{root}/.manifest.tmp", f"{root}/manifest.jsonl")
