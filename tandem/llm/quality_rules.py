"""Quality rules: an ordered decision list learned by sequential covering.

``measure`` counts, in one vectorised pass over whole texts, what the rules look
at.  ``learn`` grows threshold conjunctions on labelled rows, prunes each on rows
held back from growing, and keeps only those whose precision holds there.
``DecisionList.keep`` is the list as one Spark conditional expression, so judging
a corpus is a projection without any shuffle.

Defined edge cases: a null or empty text has no words and every count is 0; a
null label, or a label for a missing document, is ignored; several labels of one
document count as the lowest; with no labelled rows (or only one class) the list
is empty and only the base rule rejects.  Repeated rows are judged one by one;
extra columns pass through, and helper columns take names the input lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import common

#: Labelled rows the list is fitted on at most (those with the lowest hash of their id).
MAX_LABELLED = 20_000
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_bangs", "n_bars", "n_short_words",
)
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES])


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _BANG, _BAR = _flags("#*$%&|<>"), _flags("0123456789"), _flags("!?"), _flags("|")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _per_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it seen twice or more, and is it an earlier one's repeat."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = twice
    return out, again


def _count(text: pa.Array) -> np.ndarray:
    data, off = common.utf8(text)
    n = len(text)
    out = np.zeros((len(MEASURES), n), np.int64)
    if not len(data):
        return out
    start, end, row = common.words_of(data, off)
    spans = common.Spans(data)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    length = chars[end] - chars[start]
    out[0] = np.bincount(row, minlength=n)
    out[1] = np.bincount(row, length, minlength=n).astype(np.int64)
    out[2] = _per_row(_SYMBOL[data], off)
    # lines: from a row's start or a newline to the next newline or the row's end
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(off, line_start, "right") - 1
    stop = np.searchsorted(breaks, line_start)
    line_end = np.where(stop < len(breaks), breaks[np.minimum(stop, len(breaks) - 1)] if len(breaks) else len(data), len(data))
    line_end = np.minimum(line_end, off[line_row + 1])
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    salt = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
    _, again = _repeated(spans.hash(line_start, line_end) ^ salt[line_row])
    out[3] = np.bincount(line_row, again, minlength=n).astype(np.int64)
    # words in 5-word windows that the row has twice or more
    hashes = spans.hash(start, end)
    wide = np.flatnonzero(row[:-4] == row[4:]) if len(row) > 4 else np.zeros(0, np.int64)
    if len(wide):
        key = np.zeros(len(wide), np.uint64)
        for j in range(5):
            key += hashes[wide + j] * np.uint64((0xA0761D6478BD642F * (2 * j + 3) ** 5) % (1 << 64) | 1)
        twice, _ = _repeated(common.mix(key) ^ salt[row[wide]])
        cover = np.zeros(len(row) + 1, np.int64)
        np.add.at(cover, wide[twice], 1)
        np.add.at(cover, wide[twice] + 5, -1)
        out[4] = np.bincount(row, np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)
    out[5] = np.bincount(line_row, minlength=n)
    out[6], out[7] = _per_row(_UPPER[data], off), _per_row(_DIGIT[data], off)
    out[8], out[9] = _per_row(_BANG[data], off), _per_row(_BAR[data], off)
    out[10] = np.bincount(row, length <= 2, minlength=n).astype(np.int64)
    return out


@F.arrow_udf(_TYPE)
def measure(text: pa.Array) -> pa.Array:
    """The counts of MEASURES for each whole text."""
    parts = [_count(text.slice(a, n)) for a, n in common.slices(text, common.SPAN_BYTES)] or [np.zeros((len(MEASURES), 0), np.int64)]
    return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], list(MEASURES))


#: Rates that rules test, from the counts; each is a Column expression and a numpy one alike.
def _rates(c):
    words = c["n_words"] + 1.0
    return {
        "n_words": c["n_words"] * 1.0,
        "mean_word_chars": c["word_chars"] / words,
        "symbol_rate": c["n_symbols"] / words,
        "dup_line_rate": c["n_dup_lines"] / (c["n_lines"] + 1.0),
        "repeat_rate": c["n_repeat_words"] / words,
        "upper_rate": c["n_upper"] / (c["word_chars"] + 1.0),
        "digit_rate": c["n_digits"] / (c["word_chars"] + 1.0),
        "bang_rate": c["n_bangs"] / words,
        "bar_rate": c["n_bars"] / words,
        "line_rate": c["n_lines"] / words,
        "short_rate": c["n_short_words"] / words,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (rate, is_at_least, threshold); what it covers is rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float

    def column(self, rates: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, x in self.tests:
            out = out & (rates[name] >= F.lit(x) if least else rates[name] <= F.lit(x))
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def keep(self, counts: str) -> Column:
        """True where no rule covers the row; `counts` names the struct that `measure` gave."""
        rates = _rates({c: F.col(f"{counts}.{c}") for c in MEASURES})
        case = None
        for r in self.rules:
            case = F.when(r.column(rates), F.lit(False)) if case is None else case.when(r.column(rates), F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))


def _covers(tests, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, least, t in tests:
        out &= x[name] >= t if least else x[name] <= t
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int, cuts: int) -> list:
    tests: list = []
    inside = np.ones(len(bad), bool)
    while len(tests) < max_tests and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best = (0.0, None)
        for name, values in x.items():
            v = values[inside]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest")).tolist():
                for least in (True, False):
                    hit = v >= t if least else v <= t
                    p, n = (hit & bad[inside]).sum(), (hit & ~bad[inside]).sum()
                    if not p:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, least, t))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _covers([best[1]], x)
    return tests


def _prune(tests: list, x: dict[str, np.ndarray], bad: np.ndarray) -> list:
    def worth(some: list) -> float:
        hit = _covers(some, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - 3.0 * n) / (p + n + 1.0)

    while len(tests) > 1:
        fewer = [tests[:i] + tests[i + 1 :] for i in range(len(tests))]
        best = max(fewer, key=worth)
        if worth(best) < worth(tests):
            break
        tests = best
    return tests


def fit(counts: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, cuts: int = 48, min_precision: float = 0.97, min_share: float = 0.002) -> DecisionList:
    """Sequential covering on labelled counts: grow on two thirds, prune and judge on the rest."""
    rates = {k: np.asarray(v, float) for k, v in _rates(counts).items()}
    grow = np.arange(len(bad)) % 3 != 0
    left = np.ones(len(bad), bool)
    rules, misses = [], 0
    while len(rules) < max_rules and misses < 3:
        g, h = grow & left, ~grow & left
        if (bad & g).sum() < 5 or (bad & h).sum() < 3:
            break
        tests = _grow({k: v[g] for k, v in rates.items()}, bad[g], max_tests, cuts)
        if not tests:
            break
        tests = _prune(tests, {k: v[h] for k, v in rates.items()}, bad[h])
        hit = _covers(tests, rates)
        now = hit & h
        precision = (bad & now).sum() / max(1, now.sum())
        whole = (bad & hit & left).sum() / max(1, (hit & left).sum())
        if min(precision, whole) >= min_precision and (bad & hit & left).sum() >= max(5, min_share * bad.sum()):
            rules.append(Rule(tuple(tests), int((hit & left).sum()), float(precision)))
            left &= ~hit
        else:  # set these positives aside and look for another rule
            misses += 1
            left &= ~(hit & bad)
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Fits the list on at most `max_labelled` labelled documents, the only ones measured for it."""
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    marks = common.bounded(common.cut(marks.join(texts.select("_id"), "_id", "left_semi")), "_id", max_labelled)
    rows = texts.join(F.broadcast(marks), "_id").select("_id", "_y", measure("_text").alias("_m")).select("_id", "_y", "_m.*")
    rows = rows.orderBy(F.xxhash64("_id"), *MEASURES).limit(max_labelled).toPandas()
    if not len(rows) or rows["_y"].nunique() < 2:
        return DecisionList(())
    return fit({c: rows[c].to_numpy() for c in MEASURES}, rows["_y"].to_numpy() == 0)


def base_failed(counts: str) -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    words, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    rules = learn(docs, labels, id_col, text_col)
    table = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("counts"))
    kept = ~base_failed("counts") & rules.keep("counts")
    return table.select("doc_id", *[F.col(f"counts.{c}") for c in MEASURES[:5]], base_failed("counts").alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the base rule and the learned list keep, all columns as they were."""
    (counts,) = common.fresh(docs, "counts")
    rules = learn(docs, labels, id_col, text_col)
    return docs.withColumn(counts, measure(F.col(text_col))).where(~base_failed(counts) & rules.keep(counts)).drop(counts)
