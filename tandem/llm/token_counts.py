"""Token counts of a SentencePiece BPE model without making token ids.

No piece of such a model joins a space to a character before it, so a text falls
into pre-tokens (a run of spaces and what follows, the model's leading space
included) that are encoded apart.  Pieces are counted once for each distinct
pre-token of the corpus; a text's count is the sum of its pre-tokens' counts times
their frequencies in it.

The pre-tokens seen most often (at most HOT of them) go to the tasks as one broadcast
dictionary, so that no common word becomes a hot shuffle key; the rare rest joins by
key.  A pre-token of more than SHORT characters is known by its digest, so keys are
short and the dictionary's size is bounded whatever the texts.

Defined edge cases: a null or empty text has no tokens; a null id keeps its row;
repeated rows each give a row; other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import common

#: The broadcast dictionary has at most HOT entries of at most SHORT characters: under 50 MB.
HOT, SHORT = 200_000, 128
#: Begins the key of a long pre-token; a short one that begins so goes by its digest too.
_LONG = "\0#"
#: Distinct pre-tokens a task gathers before it passes its sums on.
FLUSH = 300_000
_SPACES = re.compile("[ ▁]+")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def splits_at_spaces(model) -> bool:
    """True if no piece has a space after another character."""
    for i in range(model.get_piece_size()):
        rest = model.id_to_piece(i).lstrip("▁")
        if "▁" in rest:
            return False
    return True


def pretokens(text: str) -> list[str]:
    """What the library is to encode apart: each run of spaces and the characters up to the next run.

    The first space of a run is the one that the library itself puts before a text, so
    it is left out; a text's own start gets the library's.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    out, at = [], 0
    text = " " + text
    for m in _SPACES.finditer(text, 1):
        if m.start() > at + 1 and text[at + 1 : m.start()].strip(" "):
            out.append(text[at + 1 : m.start()])
            at = m.start()
    out.append(text[at + 1 :])
    return out


def key_of(word: str) -> str:
    """The pre-token itself, or _LONG and a 128-bit digest of a long one."""
    if len(word) <= SHORT and not word.startswith(_LONG):
        return word
    return _LONG + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush():
        keys = [key_of(w) for w in seen]
        words = [None if k == w else w for k, w in zip(keys, seen, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "word", "n"])
        seen.clear()

    for batch in batches:
        text = batch.column(0)
        for a, n in common.slices(text):
            for x in text.slice(a, n).to_pylist():
                if x:
                    seen.update(pretokens(x))
            if len(seen) > FLUSH:
                yield from flush()
    yield from flush()


def _pieces(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            words = [k if w is None else w for k, w in zip(batch.column("piece").to_pylist(), batch.column("word").to_pylist(), strict=True)]
            counts = [len(x) for x in model.encode(words, num_threads=1)]
            # an empty pre-token is one lone space, which the library drops only when it is the whole text
            counts = [c if w else 1 for c, w in zip(counts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(counts, pa.int64())], ["piece", "n", "tokens"])

    return run


def _documents(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            text = batch.column("text")
            for a, n in common.slices(text):
                sums, rest, freq = [], [], []
                for x in text.slice(a, n).to_pylist():
                    total, left = 0, []
                    for w in pretokens(x or ""):
                        if len(w) > SHORT or w.startswith(_LONG):
                            w = key_of(w)
                        c = known.get(w)
                        if c is None:
                            left.append(w)
                        else:
                            total += c
                    cold = Counter(left)
                    sums.append(total)
                    rest.append(list(cold))
                    freq.append(list(cold.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("n_bytes").slice(a, n), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(freq, pa.list_(pa.int32()))],
                    ["doc_id", "n_bytes", "hot", "rest", "freq"],
                )

    return run


def piece_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Each distinct pre-token of the corpus (long ones by `key_of`), how often it stands there, and its number of tokens."""
    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(_corpus, "piece string, word string, n long").groupBy("piece", "word").agg(F.sum("n").alias("n"))
    return common.cut(seen.mapInArrow(_pieces(model), "piece string, n long, tokens long"))


def most_frequent(pieces: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, the most frequent: a histogram of frequencies gives the least one that fits."""
    eighths = F.floor(8 * F.log2("n"))
    room, cutoff = most, None
    for r in pieces.groupBy(eighths.alias("e")).count().orderBy(F.desc("e")).collect():
        room -= r["count"]
        if room < 0:
            break
        cutoff = r["e"]
    return pieces.where(eighths >= cutoff) if cutoff is not None else pieces.limit(0)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    spark = docs.sparkSession
    if not splits_at_spaces(load(model)):
        raise ValueError("a piece of this model joins a space to a character before it")
    pieces = piece_counts(docs, model, text_col)
    common_ones = most_frequent(pieces, hot).select("piece", "tokens").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(common_ones["piece"], common_ones["tokens"].tolist(), strict=True)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    table = common.cut(
        rows.mapInArrow(_documents(known), f"doc_id {kind}, n_bytes long, hot long, rest array<string>, freq array<int>").withColumn("row", F.monotonically_increasing_id())
    )
    cold = table.select("row", F.explode(F.arrays_zip("rest", "freq")).alias("x")).select("row", F.col("x.rest").alias("piece"), F.col("x.freq").alias("freq"))
    sums = cold.join(pieces.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("freq") * F.col("tokens")).alias("cold"))
    total = F.col("hot") + F.coalesce(F.col("cold"), F.lit(0))
    return table.select("row", "doc_id", "n_bytes", "hot").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
