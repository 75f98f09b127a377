"""Helpers shared by the corpus operators.

``cut`` writes an intermediate table to the cluster's shared folder and reads it
back, so a lost executor costs one task and never the lineage above the table.
The numpy helpers hash all words of an Arrow batch at once; they are the inside
of ``mapInArrow`` functions and keep memory bounded by working on slices of a
few megabytes of text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Bytes of text at a time where several numbers of eight bytes stand beside each byte (`Spans`).
SPAN_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker (with its last row under 4 MB, the size of the buffer), and Spark's setting for it.
BATCH_BYTES, BATCH_SETTING = 3 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Powers are kept for a multiple of so many bytes.
_STEP = 1 << 18
#: Byte classes of `[^\x20\x09-\x0D]+` words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_own: list[str] = []
_tables: dict[int, tuple] = {}
#: A key with more than this part of all rows is hot; fewer than SHARES keys can be.
SHARES = 4096
#: Bits for each key of a filter, and the most bits of one (16 MB).
BITS_EACH, MOST_BITS = 64, 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Unset, a folder of our own serves a local master only; a cluster needs the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own.append(_own[0] if _own else tempfile.mkdtemp(prefix="tandem-"))
        folder = _own[0]
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on `names` that df does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back.

    Tables lie under tables/<application id>; ``release`` deletes those that nothing
    reads any more, and the whole folder may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[id(table)] = (weakref.ref(table), path)
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that `cut` gave, when no result that is still to be read depends on them."""
    for table in tables:
        ref, path = _tables.pop(id(table), (lambda: None, None))
        if ref() is table:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have at most BATCH_BYTES (a row more), or fewer if its setting says so.

    Spark's own limits are 10,000 rows and 64 MB.  An executor holds each batch several
    times (as vectors that grow by doubling, on the way, in the worker), for each of its
    tasks, beside a heap that stays as large as it ever was.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH_SETTING).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def share_of(counts: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """The keys of counts (unique by key) with more than a SHARES-th of the sum of n (`total`, if known): fewer than SHARES of them, whatever the table's size."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > total / SHARES).select(key)


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row per key, on the column `key`.

    The keys in hot, as `share_of` gives them, would each fill a task; their rows of
    table, fewer than SHARES, are broadcast instead, and only the others are dealt by key.
    """
    (mark,) = fresh(rows, "hot")
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    few = table.join(F.broadcast(hot.select(key)), key, "left_semi")
    many = table.join(F.broadcast(hot.select(key)), key, "left_anti")
    one = marked.where(F.col(mark)).drop(mark).join(F.broadcast(few), key, how)
    return one.unionByName(marked.where(F.col(mark).isNull()).drop(mark).join(many, key, how))


def flagged(rows: DataFrame, table: DataFrame, flag: str, *keys: str) -> DataFrame:
    """rows with a column `flag`, false only where no row of table has their keys.

    It is told by a filter of bits of the keys' hashes, broadcast, so rows are not shuffled
    for it.  The few rows that it lets through in vain, more where a table has so many keys
    that MOST_BITS fill up, are for the join that follows: it alone decides.
    """
    size = 1 << min(MOST_BITS.bit_length() - 1, max(15, (BITS_EACH * table.count()).bit_length()))
    part, bits = fresh(rows, "part", "bits")
    slot = F.pmod(F.xxhash64(*keys), F.lit(size)) + 1
    place = F.bitmap_bit_position(slot)
    placed = table.select(F.bitmap_bucket_number(slot).alias(part), place.alias("place")).repartition(part)
    maps = placed.groupBy(part).agg(F.bitmap_construct_agg("place").alias(bits))
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    return rows.withColumn(part, F.bitmap_bucket_number(slot)).join(F.broadcast(maps), part, "left").withColumn(flag, hit).drop(part, bits)


def sift(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows without most of those whose keys table lacks, ahead of a join that drops the rest of them."""
    (flag,) = fresh(rows, "flag")
    return flagged(rows, table, flag, *keys).where(flag).drop(flag)


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows, those whose id hashes lowest; larger inputs are thinned by hash before the sort."""
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (start, count) of at most `limit` bytes of text each, but one row at least."""
    sizes = np.diff(offsets_of(text).astype(np.int64)) if len(text) else np.zeros(0, np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(text):
        yield start, len(text) - start


def offsets_of(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    off = offsets_of(col).astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(-(-n // _STEP) * _STEP, base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have


class Spans:
    """Hashes of byte spans of one slice: equal spans hash alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n], out=self.sums[1:])
        self.down = _power("down", _INV, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`; words end at row ends."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each window of `width` words.

    A row with fewer words than `width`, but at least one, has one window of all of them.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    n = len(word_hash)
    out = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        out += word_hash[j : j + len(out)] * np.uint64((0xA0761D6478BD642F * (2 * j + 3) ** 5) % (1 << 64) | 1)
    at = np.flatnonzero(row[: len(out)] == row[width - 1 :]) if len(out) else np.zeros(0, np.int64)
    hashes, rows = mix(out[at]), row[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for r in short.tolist():
            h = 0x51ED270B * int(count[r])
            for x in word_hash[first[r] : first[r] + count[r]].tolist():
                h = (h * 0x9FB21C651E98DF25 + x) % (1 << 64)
            extra.append(h)
        hashes = np.concatenate([hashes, mix(np.array(extra, np.uint64))])
        rows, at = np.concatenate([rows, short]), np.concatenate([at, first[short]])
        order = np.argsort(rows, kind="stable")
        hashes, rows, at = hashes[order], rows[order], at[order]
    return hashes, rows, at
