"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text, counted in one vectorised pass: density of a fixed lexicon
of insults and of word stems learned from labelled rows, insults near a
second-person pronoun, shares of capitals and shouted words, punctuation rates, and
obfuscated spellings (digits or symbols inside a word, stretched letters).

The trees learn from at most MAX_LABELLED labelled rows (those whose id hashes
lowest), a fifth of them set aside to fit the calibration.  Scoring is one
projection over the corpus.

Defined edge cases: a null or empty text has all features 0 but ``words``, which is the
logarithm of 2 as for any text without words, and gets the score of such a row; null
labels and labels without a document are ignored, several labels
of a document count as the highest; without both classes the score is the
smoothed share of label 1.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import common

#: Labelled rows used at most, and stems learned at most.
MAX_LABELLED, MAX_LEARNED = 12_000, 64
#: Insults (fixed values, in natural order).
LEXICON = (
    "asshole bastard bitch bullshit clown coward creep crap cretin damn degenerate dickhead disgusting dumb dumbass failure "
    "fool freak fuck garbage hate hideous idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic nasty "
    "parasite pathetic pig psycho rat retard scum scumbag shit sick slut stupid subhuman swine trash ugly useless vermin "
    "vile whore worthless wretch"
).split()
SECOND_PERSON = "you your yours yourself u ur thou".split()
FEATURES = ("lexicon", "learned", "n_learned", "distinct", "near_you", "capitals", "shouted", "bangs", "stops", "masked", "stretched", "words")
#: Words within which an insult is near a second-person pronoun.
NEAR = 6
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _BANG, _STOP, _MASK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_BANG[[33, 63]] = True
_STOP[[44, 46, 58, 59]] = True
_MASK[[35, 36, 42, 64, *range(48, 58)]] = True
_ALPHA = _LETTER.copy()
_ALPHA[48:58] = False


def _hash_words(words) -> np.ndarray:
    """Hashes of words as `common.Spans` gives them, sorted."""
    raw = [w.encode() for w in words]
    if not raw:
        return np.zeros(0, np.uint64)
    end = np.cumsum([len(w) for w in raw])
    return np.unique(common.Spans(np.frombuffer(b"".join(raw), np.uint8)).hash(np.concatenate(([0], end[:-1])), end))


def _runs_of(flag: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of flagged bytes; runs break at edges."""
    start = flag.copy()
    start[1:] &= ~flag[:-1] | edge[1:-1]
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _count(text: pa.Array, insults: np.ndarray, stems: tuple[np.ndarray, ...], you: np.ndarray) -> np.ndarray:
    n = len(text)
    out = np.zeros((len(FEATURES), n))
    raw, off = common.utf8(text)
    low, low_off = common.utf8(pc.utf8_lower(text.fill_null("") if text.null_count else text))
    chars = np.diff(off) + 1.0
    out[11] = np.log(2)
    if not len(raw):
        return out
    total = lambda row, weight=None: np.bincount(row, weight, minlength=n)
    row_at = lambda at, o: np.searchsorted(o, at, "right") - 1
    edge = np.zeros(len(low) + 1, bool)
    edge[low_off] = True
    start, end = _runs_of(_LETTER[low], edge)
    row = row_at(start, low_off)
    spans = common.Spans(low)
    whole = spans.hash(start, end)
    insult = np.isin(whole, insults)
    # the place of each word's k-th character, for stems of k characters
    lead = np.flatnonzero((low & 0xC0) != 0x80)
    first = np.searchsorted(lead, start)
    lead = np.append(lead, [len(low)] * 8)
    learned = np.zeros(len(start), bool)
    for k, hashes in zip(STEMS, stems, strict=True):
        stop = lead[first + k]
        at = np.flatnonzero(stop <= end)
        learned[at] |= np.isin(spans.hash(start[at], stop[at]), hashes)
    words = total(row) + 1.0
    out[0] = total(row, insult) / words
    out[1] = total(row, learned) / words
    out[2] = total(row, learned)
    hit = insult | learned
    kinds = np.unique(np.stack([row[hit].astype(np.uint64), whole[hit]]), axis=1)
    out[3] = np.bincount(kinds[0].astype(np.int64), minlength=n)
    mine, theirs = np.flatnonzero(insult), np.flatnonzero(np.isin(whole, you))
    if len(mine) and len(theirs):
        after = np.searchsorted(theirs, mine)
        near = np.zeros(len(mine), bool)
        for side in (np.minimum(after, len(theirs) - 1), np.maximum(after - 1, 0)):
            near |= (np.abs(theirs[side] - mine) <= NEAR) & (row[theirs[side]] == row[mine])
        out[4] = total(row[mine], near) / words
    upper = np.flatnonzero(_UPPER[raw])
    out[5] = total(row_at(upper, off)) / chars
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    a, b = _runs_of(_UPPER[raw], edge)
    shout = a[(b - a >= 3) & ((a == 0) | ~_LETTER[raw[a - 1]] | edge[a]) & ((b == len(raw)) | ~_LETTER[raw[np.minimum(b, len(raw) - 1)]])]
    out[6] = total(row_at(shout, off)) / words
    out[7] = total(row_at(_runs_of(_BANG[raw], edge)[0], off)) / words
    out[8] = total(row_at(np.flatnonzero(_STOP[raw]), off)) / words
    a, b = _runs_of(_MASK[raw], edge)
    inside = (a > 0) & (b < len(raw))
    a, b = a[inside], b[inside]
    a = a[_ALPHA[raw[a - 1]] & _ALPHA[raw[b]] & ~edge[a] & ~edge[b]]
    out[9] = total(row_at(a, off)) / words
    if len(low) > 2:
        same = _ALPHA[low[2:]] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & ~edge_of(low_off, len(low))[2:-1] & ~edge_of(low_off, len(low))[1:-2]
        at, _ = _runs_of(same, np.zeros(len(same) + 1, bool))
        out[10] = total(row_at(at, low_off)) / words
    out[11] = np.log1p(words)
    return out


def edge_of(off: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[off] = True
    return out


#: Lengths of learned stems, in characters.
STEMS = (4, 6)


def features(learned: list[str]):
    """A function of a text column: the struct of FEATURES of each whole text."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in FEATURES]))
    def count(text: pa.Array) -> pa.Array:
        insults, you = _hash_words(LEXICON), _hash_words(SECOND_PERSON)
        stems = tuple(_hash_words([w for w in learned if len(w) == k]) for k in STEMS)
        parts = [_count(text.slice(a, n), insults, stems, you) for a, n in common.slices(text)] or [np.zeros((len(FEATURES), 0))]
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], list(FEATURES))

    return count


def learned_stems(rows: DataFrame, most: int = MAX_LEARNED) -> list[str]:
    """First 4 or 6 letters of words that mark label 1: in 1 % of its rows (3 at least) and 8 times as frequent as elsewhere.

    Insults are inflected and compounded, so stems hold where whole words are too
    rare.  A row counts a stem at most 5 times.  A stem that starts with another stem
    taken is left out.
    """
    totals = rows.groupBy().agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = totals["n1"] or 0, totals["n0"] or 0
    if not n1 or not n0:
        return []
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])\p{L}{4,40}"), F.lit(0))
    both = rows.select("doc_id", "label", F.explode(words).alias("word")).select("doc_id", "label", F.explode(F.array_distinct(F.array(F.substring("word", 1, 4), F.substring("word", 1, 6)))).alias("w"))
    by = both.groupBy("doc_id", "label", "w").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("c")).groupBy("w").agg(
        F.sum("label").alias("docs"), F.sum(F.col("label") * F.col("c")).alias("a"), F.sum((1 - F.col("label")) * F.col("c")).alias("b")
    )
    odds = (F.col("a") / n1) / ((F.col("b") + 1.0) / n0)
    picked = [r["w"] for r in by.where((F.col("docs") >= max(3, 0.01 * n1)) & (odds >= 8)).orderBy(F.desc(F.col("docs") * F.log(odds)), "w").limit(4 * most).collect()]
    kept = [w for w in picked if not any(w != v and w.startswith(v) for v in picked)]
    return sorted(kept[:most])


def _boost(train: DataFrame, vector: str, label: str):
    return GBTClassifier(featuresCol=vector, labelCol=label, maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxBins=64, subsamplingRate=1.0, checkpointInterval=-1).fit(train)


def _isotonic(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over sorted (score, label): steps as (least score, calibrated value)."""
    points: dict[float, list[float]] = {}
    for x, y in sorted(pairs):
        point = points.setdefault(x, [x, 0.0, 0.0])
        point[1] += y
        point[2] += 1
    blocks: list[list[float]] = []  # least score, sum, weight
    for point in points.values():
        blocks.append(point)
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, w = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += w
    return [(b[0], b[1] / b[2]) for b in blocks]


def _step(score: Column, steps: list[tuple[float, float]]) -> Column:
    """The calibrated step under a score, with a tenth of a hundredth of the raw score to keep an order inside it."""
    case = F.lit(steps[0][1])
    for least, y in steps[1:]:
        case = F.when(score >= least, F.lit(y)).otherwise(case)
    return F.lit(0.999) * case + F.lit(0.001) * score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1] and predicted.

    Labels are learned only from documents whose crc32(id as text) mod 5 is not 0, at most
    max_labelled of them; of rows that share an id one text, that of the least hash, is learned from.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .where(fold("doc_id") != 0)
    )
    # only labels of documents that are there count towards the bound
    there = docs.select(F.col(id_col).alias("doc_id"))
    marks = common.bounded(common.cut(marks.join(there, "doc_id", "left_semi")), "doc_id", max_labelled)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an id that many rows share is learned from one of its texts, so the bound holds for rows too
    rows = common.cut(plain.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    learned = learned_stems(rows.where(~aside))
    count = features(learned)
    vector = lambda df: VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(df)
    sample = vector(common.cut(rows.select("doc_id", F.col("label").cast("double").alias("label"), count(F.col("text")).alias("f")).select("doc_id", "label", "f.*")))
    train, hold = sample.where(~aside).cache(), sample.where(aside)
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    out = plain.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), count(F.col("text")).alias("f")).select("doc_id", "held_out", "f.*")
    if len(n) < 2:
        score = F.lit((n.get(1.0, 0) + 0.5) / (sum(n.values()) + 1))
        return out.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    model = _boost(train, "x", "label")
    train.unpersist()
    chance = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    steps = _isotonic([(r["p"], r["label"]) for r in chance(hold).select("p", "label").collect()]) or [(0.0, 0.0)]
    if len(steps) < 2:
        steps = [(0.0, steps[0][1])]
    return chance(vector(out)).withColumn("score", _step(F.col("p"), steps)).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
