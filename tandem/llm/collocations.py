"""Phrase collocations mined from position bitmaps.

A shard, a few megabytes of one language's texts, gives every word the positions at
which it stands as a compressed bitmap: only bytes of eight positions that are not
empty are held.  Between two pieces of text a position stays free, so a bitmap
shifted by one cannot reach into the next piece.  A phrase is extended depth first:
its bitmap, shifted, is ANDed with the bitmaps of the words in the same bytes, and
the set bits are counted.  Counts are summed over shards by Spark.

Three passes go over the texts: words, pairs of frequent words, triples both of whose
pairs are frequent.  What is frequent is told to the tasks as bits in a filter of at
most MOST_BITS; a phrase that it lets through in vain is counted like any other and
goes when the exact sums are compared, so the filter's size changes the work and
never the result.

Defined edge cases: a null text is empty; a null language is `und`; repeated rows
count each time; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import common

#: Text of a shard, and entries of the phrases that are extended together.
SHARD_BYTES, BLOCK = 6 << 20, 1 << 16
#: Bits for each frequent phrase, and the most of a filter (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes: 0 word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _hashes(strings: pa.Array, lang: str) -> np.ndarray:
    data, off = common.utf8(strings)
    salt = common.utf8(pa.array([lang]))[0]
    of_lang = common.Spans(salt).hash(np.array([0]), np.array([len(salt)]))[0]
    return common.mix(common.Spans(data).hash(off[:-1], off[1:]) ^ of_lang)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return common.mix(first * _PAIR + second)


class Shard:
    """Words of some texts of one language and where they stand."""

    def __init__(self, lang: str, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.lang = lang
        data = _LOWER[np.concatenate([d for d, _ in texts])] if texts else np.zeros(0, np.uint8)
        ends = np.cumsum([0, *[len(d) for d, _ in texts]])
        edges = np.concatenate([[0], *[off[1:] + at for (_, off), at in zip(texts, ends[:-1], strict=True)]]).astype(np.int64)
        kind = _KIND[data]
        solid = kind == 0
        new_text = np.zeros(len(data) + 1, bool)
        new_text[edges] = True
        left = np.concatenate([[False], solid[:-1]])[: len(data)]
        right = np.concatenate([solid[1:], [False]])[: len(data)]
        start = np.flatnonzero(solid & (~left | new_text[:-1]))
        end = np.flatnonzero(solid & (~right | new_text[1:])) + 1
        del left, right
        piece = np.cumsum((kind == 2) | new_text[:-1], dtype=np.int32)[start]
        words = _strings(data[solid], end - start).dictionary_encode()
        self.words, ids = words.dictionary.cast(pa.string()), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.bincount(ids, minlength=len(self.words))
        self.ids = ids
        self.slots = np.arange(len(ids)) + np.cumsum(np.concatenate([[False], piece[1:] != piece[:-1]]))[: len(ids)]
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = _hashes(self.words, self.lang)
        return self._hash

    def bitmaps(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, byte number, bits) of the wanted words, by word and byte."""
        hold = wanted[self.ids]
        ids, slots = self.ids[hold], self.slots[hold]
        order = np.argsort(ids, kind="stable")
        ids, slots = ids[order], slots[order]
        at, bit = slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8)
        if not len(ids):
            return ids, at, bit
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])]))
        return ids[first], at[first], np.bitwise_or.reduceat(bit, first)


def shifted(phrase: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every bitmap one position on; what leaves a byte is carried into the next one."""
    here, carry = (bits << 1).astype(np.uint8), bits >> 7
    a, b = here != 0, carry != 0
    return np.concatenate([phrase[a], phrase[b]]), np.concatenate([at[a], at[b] + 1]), np.concatenate([here[a], carry[b]])


class Words:
    """The words' bitmaps laid out by byte number, to be ANDed with phrases."""

    def __init__(self, word: np.ndarray, at: np.ndarray, bits: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.word, self.bits = word[order], bits[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at))]) if len(at) else np.zeros(1, np.int64)

    def extend(self, phrase: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, byte number, bits) of each phrase's bitmap shifted and ANDed with every word's."""
        phrase, at, bits = shifted(phrase, at, bits)
        inside = at < len(self.start) - 1
        phrase, at, bits = phrase[inside], at[inside], bits[inside]
        n = self.start[at + 1] - self.start[at]
        entry = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(entry)) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        both = bits[entry] & self.bits[place]
        hit = np.flatnonzero(both)
        entry, place = entry[hit], place[hit]
        return phrase[entry], self.word[place], at[entry], both[hit]


def grouped(first: np.ndarray, word: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extended phrases numbered from 0: (first, word, popcount) of each and (number, byte, bits) of their entries."""
    order = np.lexsort((word, first))
    first, word, at, bits = first[order], word[order], at[order], bits[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (word[1:] != word[:-1])])[: len(first)]
    head = np.flatnonzero(new)
    counts = np.add.reduceat(_ONES[bits], head) if len(head) else np.zeros(0, np.int64)
    return first[head], word[head], counts, np.cumsum(new) - 1, at, bits


class Bits:
    """A filter of phrases' hashes: never a wrong no."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        k = h & np.uint64(len(self.words) * 64 - 1)
        return (self.words[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) != 0


def mine(shard: Shard, words: Bits, pairs: Bits | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of the shard's pairs of words that the filter has, or of triples of pairs that it has."""
    wanted = words.has(shard.hash) if len(shard.words) else np.zeros(0, bool)
    word, at, bits = shard.bitmaps(wanted)
    table = Words(word, at, bits)
    lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(word):  # a class of first words at a time; one word's whole bitmap at least
        cut = np.searchsorted(lead, begin + BLOCK, "right")
        end = lead[cut] if cut < len(lead) else len(word)
        if end <= begin:
            end = len(word)
        one, two, counts, number, b_at, b_bits = grouped(*table.extend(word[begin:end], at[begin:end], bits[begin:end]))
        begin = end
        if pairs is None:
            yield pc.binary_join_element_wise(shard.words.take(pa.array(one)), shard.words.take(pa.array(two)), " "), counts
            continue
        good = pairs.has(_joined(shard.hash[one], shard.hash[two]))
        hold = good[number]
        number, b_at, b_bits = number[hold], b_at[hold], b_bits[hold]
        for a in range(0, len(number), BLOCK):  # entries of a phrase may fall into two blocks; their counts are summed later
            pair, three, counts, *_ = grouped(*table.extend(number[a : a + BLOCK], b_at[a : a + BLOCK], b_bits[a : a + BLOCK]))
            ok = pairs.has(_joined(shard.hash[two[pair]], shard.hash[three]))
            pair, three, counts = pair[ok], three[ok], counts[ok]
            yield pc.binary_join_element_wise(shard.words.take(pa.array(one[pair])), shard.words.take(pa.array(two[pair])), shard.words.take(pa.array(three)), " "), counts


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of one language each, together at most SHARD_BYTES of text (one text at least)."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        text = batch.column("text")
        for a, n in common.slices(text):
            langs, part = batch.column("lang").slice(a, n), text.slice(a, n)
            for lang in langs.unique().to_pylist():
                data, off = common.utf8(part.filter(pc.equal(langs, lang)))
                held.setdefault(lang, []).append((data, off))
                size += len(data)
            if size >= SHARD_BYTES:
                yield from (Shard(lang, texts) for lang, texts in held.items())
                held, size = {}, 0
    yield from (Shard(lang, texts) for lang, texts in held.items())


def _counter(level: int, words=None, pairs=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = [(shard.words, shard.counts)] if level == 1 else mine(shard, Bits(words.value), Bits(pairs.value) if level == 3 else None)
            for phrases, counts in found:
                lang = pa.array([shard.lang], pa.string()).take(pa.array(np.zeros(len(phrases), np.int64)))
                yield pa.RecordBatch.from_arrays([lang, phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    return run


def _filter_bits(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                phrases = batch.column("phrase").filter(pc.equal(langs, lang))
                parts = pc.split_pattern(phrases, " ")
                h = [_hashes(pc.list_element(parts, i), lang) for i in range(width)]
                k = (h[0] if width == 1 else _joined(*h)) & np.uint64(size - 1)
                np.bitwise_or.at(bits, (k >> np.uint64(6)).astype(np.int64), np.uint64(1) << (k & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at].view(np.int64), pa.int64())], ["at", "bits"])

    return run


def filter_of(frequent: DataFrame, width: int, n: int) -> np.ndarray:
    """The bits of the frequent phrases' hashes, at most MOST_BITS of them whatever the table's size."""
    size = 1 << 12
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2
    rows = frequent.select("lang", "phrase").mapInArrow(_filter_bits(width, size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def _frequent(found: DataFrame, least: int) -> DataFrame:
    """Sums of at least `least`.  A shard's counts are sums already and few recur in a task, so they are dealt as they come."""
    found = found.repartition("lang", "phrase")
    return common.cut(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))


def _part(phrase: str, n: int):
    return F.substring_index(phrase, " ", n)


def collocations(docs: DataFrame, least: int = 10, keep: int = 2000, overlap: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `keep` phrases of two or three words: lang, rank, phrase, a, l, r, n, score."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "lang string, phrase string, f long"
    vocabulary = common.cut(texts.mapInArrow(_counter(1), schema).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    words = vocabulary.where(F.col("f") >= least)
    word_bits = context.broadcast(filter_of(words, 1, words.count()))
    pairs = _frequent(texts.mapInArrow(_counter(2, word_bits), schema), least)
    pair_bits = context.broadcast(filter_of(pairs, 2, pairs.count()))
    triples = _frequent(texts.mapInArrow(_counter(3, word_bits, pair_bits), schema), least)

    covered = triples.select("lang", F.explode(F.array(_part("phrase", 2), _part("phrase", -2))).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = pairs.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < overlap * F.col("f"), F.lit(True)))
    f_of = lambda table, part, f: table.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    two = whole.select("lang", "phrase", F.col("f").alias("a"), _part("phrase", 1).alias("p1"), _part("phrase", -1).alias("q1"))
    two = two.join(f_of(words, "p1", "l1"), ["lang", "p1"]).join(f_of(words, "q1", "r1"), ["lang", "q1"]).select("lang", "phrase", "a", "l1", "r1", F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2"))
    three = triples.select("lang", "phrase", F.col("f").alias("a"), _part("phrase", 1).alias("p1"), _part("phrase", -2).alias("q1"), _part("phrase", 2).alias("p2"), _part("phrase", -1).alias("q2"))
    three = three.join(f_of(words, "p1", "l1"), ["lang", "p1"]).join(f_of(words, "q2", "r2"), ["lang", "q2"]).join(f_of(pairs, "q1", "r1"), ["lang", "q1"]).join(f_of(pairs, "p2", "l2"), ["lang", "p2"])
    cand = two.unionByName(three.select(*two.columns))
    # products of 38 digits, divided as integers: exact
    score = lambda k: F.expr(f"cast((cast(1000000 * cast(a as decimal(16,0)) as decimal(22,0)) * cast(a as decimal(16,0))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0))) as bigint)")
    cand = cand.withColumns({"s1": score(1), "s2": F.when(F.col("l2").isNotNull(), score(2))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    cand = cand.select("lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = cand.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
