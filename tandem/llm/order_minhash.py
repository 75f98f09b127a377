"""Order MinHash fingerprints of documents, in DataFrame functions only.

A text's words (cut into pieces of at most 16 code points) give its k-mers of K
pieces; the o-th occurrence of a k-mer is an element of its own.  Every element
has one hash.  The hash range is cut into BINS bins; a bin takes the TUPLE least
elements from its lower bound on (running on into the following bins, around the
end), puts them in text order and hashes the tuple.  Order and multiplicity enter
the signature, so likeness follows edit distance rather than set overlap alone.
Hashing once and cutting the range stands for BINS independent orders at a
BINS-th of the work; in a text of few elements neighbouring bins share elements, so
its likeness is coarser than that of BINS independent orders (the README has figures).

The next document is found without a global sort: ids are cut at their
approximate quantiles, each part is sorted on its own, and the first row of every
part is lent to the part before it (the very first to the last).

Defined edge cases: null and empty texts have the fingerprint of no k-mer (all
zeros), alike 1.0 to one another; white space does not enter fingerprints; rows
that share an id follow each other in the order of their texts; a row without id
has no next document (its edited text gets nothing, near_next is 0).  A place is kept in
24 bits: k-mers of a text with more are numbered in steps, so that their order holds
but for neighbours in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import common

K, TUPLE, BINS = 2, 2, 64
_POS = (1 << 24) - 1
#: K-mers that have a place of their own.
POSITIONS = 1 << 24
#: Parts of the id range at most; their bounds and first rows are all that the driver sees.
MAX_PARTS = 65_536


def _high(x: Column) -> Column:
    return F.shiftright(x, 24)


def _bin(x: Column) -> Column:
    """0..BINS-1, rising with a signed hash."""
    return F.shiftright(x, 58) + 32


def add_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df with out_col: BINS ints, the order MinHash signature of text_col.

    Each step's arrays are columns that the next step reads more than once, so that the
    optimizer keeps the steps apart instead of computing an array once per element.
    """
    h, p, first, again, s, sel, ring = common.fresh(df, "h", "p", "first", "again", "s", "sel", "ring")
    keep = df.columns
    step = df.withColumn(h, F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0)), lambda x: F.xxhash64(x)))
    # k-mers as hash (40 bits) and position (24 bits), sorted
    n = F.size(h)
    kmer = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(K)])
    kmers = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), kmer)).when(n > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>"))
    place = lambda i: F.when(n <= POSITIONS, i.cast("long")).otherwise(F.floor(i * (F.lit(float(POSITIONS)) / n)))
    step = step.select(*keep, F.sort_array(F.transform(kmers, lambda x, i: x.bitwiseAND(~_POS).bitwiseOR(place(i)))).alias(p))
    before = lambda j: F.get(F.col(p), j - 1)
    step = step.select(
        *keep,
        F.filter(p, lambda x, j: (j == 0) | (_high(x) != _high(before(j)))).alias(first),
        F.filter(p, lambda x, j: (j > 0) & (_high(x) == _high(before(j)))).alias(again),
    )
    # repeats: runs of one k-mer, numbered from 1
    heads = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda j: (j == 0) | (_high(F.get(F.col(again), j)) != _high(F.get(F.col(again), j - 1))))
    run = F.when(F.size(again) > 0, heads).otherwise(F.array().cast("array<int>"))
    (starts,) = common.fresh(step, "starts")
    step = step.withColumn(starts, run)
    element = lambda x, o: F.xxhash64(_high(x), o).bitwiseAND(~_POS).bitwiseOR(x.bitwiseAND(_POS))
    numbered = F.flatten(
        F.transform(
            F.col(starts),
            lambda a, i: F.transform(
                F.slice(F.col(again), a + 1, F.coalesce(F.get(F.col(starts), i + 1), F.size(again)) - a),
                lambda x, o: element(x, o + 1),
            ),
        )
    )
    step = step.select(*keep, F.sort_array(F.concat(F.transform(first, lambda x: element(x, F.lit(0))), F.when(F.size(again) > 0, numbered).otherwise(F.array().cast("array<bigint>")))).alias(s))
    step = step.select(*keep, F.filter(s, lambda x, j: (j < TUPLE) | (_bin(F.get(F.col(s), j - TUPLE)) != _bin(x))).alias(sel))
    step = step.select(*keep, F.col(sel), F.concat(F.col(sel), F.slice(F.col(sel), 1, TUPLE), F.slice(F.col(sel), 1, TUPLE)).alias(ring))

    def tuple_of(b: Column) -> Column:
        size = F.size(sel)
        at = F.aggregate(
            F.array(*[F.lit(1 << i) for i in range((BINS * TUPLE).bit_length() - 1, -1, -1)]),
            F.lit(0),
            lambda acc, w: F.when((acc + w <= size) & (_bin(F.get(F.col(sel), acc + w - 1)) < b), acc + w).otherwise(acc),
        )
        ordered = F.sort_array(F.transform(F.slice(F.col(ring), at + 1, TUPLE), lambda x: F.shiftleft(x.bitwiseAND(_POS), 39).bitwiseOR(F.shiftright(x, 25).bitwiseAND((1 << 39) - 1))))
        return F.shiftright(F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND((1 << 39) - 1))), 32).cast("int")

    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    signature = F.when(F.size(sel) > 0, F.transform(bins, tuple_of)).otherwise(F.transform(bins, lambda b: F.lit(0)))
    return step.select(*keep, signature.alias(out_col))


def likeness(a: Column, b: Column) -> Column:
    """The share of bins whose tuples agree: 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))


def show(signature: Column) -> Column:
    """A signature as text: 8 hex digits a bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def lend_firsts(rows: DataFrame, id_col: str, parts: int) -> DataFrame:
    """rows (id_col never null) with _part, _wrap and _own: cut into parts by id, each with its successor's first row lent."""
    parts = max(1, min(parts, MAX_PARTS))
    bounds = rows.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.lit(0)
    if bounds:
        array = F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
        part = F.aggregate(
            F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)]),
            F.lit(0),
            lambda acc, w: F.when((acc + w <= len(bounds)) & (F.get(array, acc + w - 1) < F.col(id_col)), acc + w).otherwise(acc),
        )
    dealt = rows.withColumn("_part", part)
    firsts = sorted((r["_part"], r["id"]) for r in dealt.groupBy("_part").agg(F.min(id_col).alias("id")).collect())
    lent = [(i, firsts[k - 1][0] if k else firsts[-1][0], int(k == 0)) for k, (_, i) in enumerate(firsts)]
    lent_to = rows.sparkSession.createDataFrame(lent, "_id long, _to int, _wrap int")
    spare = rows.join(F.broadcast(lent_to), F.col(id_col) == F.col("_id")).select(*rows.columns, F.col("_to").alias("_part"), "_wrap", F.lit(False).alias("_own"))
    return dealt.select(*rows.columns, "_part", F.lit(0).alias("_wrap"), F.lit(True).alias("_own")).unionByName(spare)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last n_chars div 2 code points replaced by the first as many
    of the next document, by ascending id (the first follows the last).
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lent = lend_firsts(rows.where("doc_id is not null"), "doc_id", parts)
    alone = rows.where("doc_id is null").select("*", F.lit(-1).alias("_part"), F.lit(0).alias("_wrap"), F.lit(True).alias("_own"))
    signed = add_fingerprint(lent.unionByName(alone), "text", "mark")
    # a row without id stands alone; those rows share no part with any other and are spread by their text
    by = Window.partitionBy("_part", F.when(F.col("_part") < 0, F.xxhash64("text"))).orderBy("_wrap", "doc_id", "text", F.desc("_own"))
    follows = lambda c: F.when(F.col("_part") >= 0, F.lead(c).over(by))
    chained = signed.select("*", follows("text").alias("next_text"), follows("mark").alias("next_mark")).where("_own")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(coalesce(next_text, ''), 1, length(text) div 2)"))
    out = add_fingerprint(chained.select("doc_id", F.length("text").cast("long").alias("n_chars"), "mark", "next_mark", edited.alias("edited")), "edited", "edited_mark")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        show(F.col("mark")).alias("fingerprint"),
        show(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        F.coalesce(likeness(F.col("mark"), F.col("next_mark")), F.lit(0.0)).alias("near_next"),
    )
