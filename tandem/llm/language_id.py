"""Languages by rank-order profiles.

A profile is the most frequent n-grams of one to three letters in order of frequency,
a space standing for the edge of a word.  A language's profile comes from the sums
over all its labelled texts; a document's from its whole text.  The document's
distance to a language is the sum, over its profile, of how far each n-gram is out of
place in the language's, SIZE for one that is not there; the nearest language is the
prediction.  N-grams are known by their code points, 21 bits each, so nothing collides.

Ranks count from 0 by frequency, then by code points; languages at equal distance go by
name.  The score is how much nearer the prediction is than the runner-up, as a part of
the runner-up's distance (with one language: of the greatest distance possible).

Profiles of all languages go to the tasks: SIZE n-grams for each, so their size is
bounded by the number of languages and not by the corpus.

Defined edge cases: a null text, or one without a letter, is `und` with score 0; so is
every text where no language was learned.  A null language teaches nothing, a null id is
not held out.  Repeated rows each give a row, texts of any length are read whole, an
empty table gives no rows, other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import common

SIZE = 300
#: Text whose n-grams are held at once, and n-grams a task gathers before it passes their sums on.
SLICE, FLUSH = 1 << 20, 1 << 20
_EDGE, _SHIFT = np.int64(0x20), np.int64(21)
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three letters of every text, by row: packed code points and their row.

    Case is folded, all that is no letter parts words, and an n-gram may have a word's
    edge at its ends but not inside.
    """
    lowered = pc.utf8_lower(text)
    data, off = common.utf8(lowered)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[off]  # offsets in code points
    size = np.diff(starts)
    # an edge before every text and after the last one
    row = np.repeat(np.arange(len(size) + 1), np.append(size + 1, 1))
    line = np.full(len(points) + len(size) + 1, _EDGE)
    place = np.ones(len(line), bool)
    place[starts + np.arange(len(starts))] = False
    line[place] = points
    solid = place & _letters()[line]
    line[~solid] = _EDGE
    hold = solid | np.concatenate([[True], solid[:-1]])  # of several edges in a row the first stays
    line, row, solid = line[hold], row[hold], solid[hold]
    two = (line[:-1] << _SHIFT) | line[1:]
    two_at = np.where(solid[:-1], row[:-1], row[1:])
    good = solid[:-1] | solid[1:]
    three = (two[:-1] << _SHIFT) | line[2:]
    keys = np.concatenate([line[solid], two[good], three[solid[1:-1]]])
    rows = np.concatenate([row[solid], two_at[good], row[1:-1][solid[1:-1]]])
    order = np.argsort(rows, kind="stable")
    return keys[order], rows[order]


def profile(keys: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent keys, ties by key."""
    values, counts = np.unique(keys, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    total = 0

    def flush():
        for lang, parts in held.items():
            keys = np.concatenate([k for k, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            values, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(sums, pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for a, n in common.slices(batch.column("text"), SLICE):
            langs, text = batch.column("lang").slice(a, n), batch.column("text").slice(a, n)
            for lang in langs.unique().to_pylist():
                keys, _ = ngrams(text.filter(pc.equal(langs, lang)))
                values, counts = np.unique(keys, return_counts=True)
                held.setdefault(lang, []).append((values, counts))
                total += len(values)
            if total > FLUSH:
                yield from flush()
                total = 0
    yield from flush()


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, place): each language's most frequent n-grams, from (lang, text) rows."""
    grams = docs.mapInArrow(_teach, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    return grams.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """All languages' ranks of all n-grams in any profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row is for n-grams in no profile
        name = {lang: i for i, lang in enumerate(self.langs)}
        self.ranks[np.searchsorted(self.grams, [r[1] for r in rows]), [name[r[0]] for r in rows]] = [r[2] for r in rows]

    def distances(self, gram: np.ndarray, rank: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each document (its n-grams begin at head) to each language."""
        at = np.searchsorted(self.grams, gram)
        known = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == gram)
        at = np.where(known, at, len(self.grams))
        out = np.empty((len(head), len(self.langs)), np.int64)
        for i in range(len(self.langs)):
            there = self.ranks[at, i]
            out[:, i] = np.add.reduceat(np.where(there < 0, self.size, np.abs(there - rank)), head)
        return out


def _predict(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Profiles = known.value
        for batch in batches:
            for a, n in common.slices(batch.column("text"), SLICE):
                part = batch.slice(a, n)
                lang, score = np.full(n, "und", object), np.zeros(n)
                keys, rows = ngrams(part.column("text"))
                seen, first = np.unique(rows, return_index=True)
                if len(seen) and table.langs:
                    tops = [profile(k, table.size) for k in np.split(keys, first[1:])]
                    head = np.cumsum([0, *map(len, tops)])[:-1]
                    rank = np.concatenate([np.arange(len(t)) for t in tops])
                    far = table.distances(np.concatenate(tops), rank, head)
                    best = np.argmin(far, axis=1)
                    least = far[np.arange(len(far)), best]
                    if len(table.langs) > 1:
                        second = np.partition(far, 1, axis=1)[:, 1]
                    else:
                        second = np.array([table.size * len(t) for t in tops])
                    lang[seen] = np.array(table.langs, object)[best]
                    score[seen] = np.where(second > 0, (second - least) / np.maximum(second, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages are learned from the labelled rows that are not held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learned = profiles(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"), size).collect()  # languages x size rows
    known = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in learned], size))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(known), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
