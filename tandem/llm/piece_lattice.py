"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct pre-tokens of a batch of texts are concatenated and indexed by a suffix array over as many
characters as the longest piece has.  Every piece of the vocabulary is looked up in
it by binary search, all pieces at once, which gives its range of occurrences.  The
occurrences are the edges of a lattice; they are sorted by where they end in their
pre-token and relaxed from left to right, for all pre-tokens at once.

For a BPE model the relaxation is exact, not a best score: the encoding of every
prefix is the encoding of a shorter prefix and one more piece, and an edge extends a
prefix just if merging would leave the border between its last piece and the edge's
piece alone.  That is decided by undoing merges on both sides, the latest first, and
asking whether one over the border would have come earlier.

A pre-token longer than LONG characters is relaxed in overlapping windows side by side: two
windows that have a token in common continue each other there, for a sequence of
pieces is the encoding just if all neighbours in it are apart.  Where two windows
have none in common the whole pre-token is relaxed at once.

Defined edge cases: null and empty texts have no ids; a character that no piece has
becomes the pieces of its bytes; U+2581 in a text encodes, as in the library, as a
space, so such a text alone does not come back from decoding; ids that form no valid
UTF-8 decode with U+FFFD; repeated rows each give a row; other columns pass through
``encode`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import common
from tandem.llm.token_counts import load, pretokens, splits_at_spaces

SPACE = "▁"
#: Text that shares one list of distinct pre-tokens: a batch as `common.small_batches` has it, and the row over its limit.
BATCH_BYTES = common.BATCH_BYTES + (1 << 20)
#: Characters of pre-tokens that are indexed at once (a longer word stands alone): bounds the suffix array and the edges.
BLOCK_CHARS = 1 << 18
#: Longest pre-token relaxed in one go, and the step and overlap of the windows of longer ones.
LONG, STEP, OVERLAP = 4096, 1024, 256
_NEVER = np.int64(1 << 40)


@dataclass
class Vocabulary:
    """Pieces by rank: single characters first, then merged pieces in the order of merging."""

    ids: np.ndarray  # rank -> id; the last rank stands for a character without a piece
    chars: np.ndarray  # rank -> code points, padded with 0
    length: np.ndarray
    left: np.ndarray  # rank -> ranks of the two pieces merged last; a character is its own
    right: np.ndarray
    pair_key: np.ndarray  # sorted left * size + right
    pair_rank: np.ndarray
    by_piece: dict[str, int]
    byte_ids: list[int]
    runs: dict[int, int]  # number of spaces -> id of the piece of so many
    raw: list[bytes]  # id -> its bytes when decoded
    raw_bytes: np.ndarray  # all of them in a row, and of each id the start and the number
    raw_start: np.ndarray
    raw_size: np.ndarray


def _merge(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain BPE of a short string; also the last pair merged."""
    parts, last = list(text), None
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    model = load(path)
    if not splits_at_spaces(model):
        raise ValueError("a piece of this model joins a space to a character before it")
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    piece = {i: model.id_to_piece(i) for i in range(n)}
    runs = {len(piece[i]): i for i in plain if not piece[i].strip(SPACE)}
    single = sorted((i for i in plain if len(piece[i]) == 1), key=lambda i: piece[i])
    # pieces of two spaces or more merge after all others and are put together by `_run`
    joined = sorted((i for i in plain if len(piece[i]) > 1 and piece[i].strip(SPACE)), key=lambda i: (-model.get_score(i), i))
    if any(piece[i].startswith(SPACE * 2) for i in joined):
        raise ValueError("a piece of this model joins several spaces to a word")
    order = {piece[i]: r for r, i in enumerate(joined)}
    kept, split = [], {}
    for i in joined:
        parts, last = _merge(piece[i], order)
        if len(parts) == 1:
            kept.append(i)
            split[i] = last
    chars_of = {piece[i] for i in single}
    missing = sorted({c for i in kept for c in piece[i]} - chars_of)
    names = [piece[i] for i in single] + missing + [piece[i] for i in kept]
    ids = [*single, *([-1] * len(missing)), *kept, -1]
    by_piece = {p: r for r, p in enumerate(names)}
    size, first = len(names) + 1, len(single) + len(missing)
    left, right = np.arange(size), np.arange(size)
    for k, i in enumerate(kept):
        left[first + k], right[first + k] = by_piece[split[i][0]], by_piece[split[i][1]]
    width = max(map(len, names))
    chars = np.zeros((size, width), np.int64)
    for r, p in enumerate(names):
        chars[r, : len(p)] = [ord(c) for c in p]
    length = np.array([*map(len, names), 1])
    key = left[first : size - 1] * size + right[first : size - 1]
    by = np.argsort(key)
    raw = [bytes([int(piece[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else piece[i].replace(SPACE, " ").encode() for i in range(n)]
    sizes = np.array([len(r) for r in raw])
    byte_ids = [0] * 256
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(piece[i][3:5], 16)] = i
    return Vocabulary(np.array(ids), chars, length, left, right, key[by], (first + np.arange(len(kept)))[by], by_piece, byte_ids, runs, raw, np.frombuffer(b"".join(raw), np.uint8), sizes.cumsum() - sizes, sizes)


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions of codes in the order of the `width` or more codes that follow, by prefix doubling."""
    n = len(codes)
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    rank = np.cumsum(seen)[codes]  # from 1; 0 stands for the end
    step, bits = 1, int(rank.max(initial=1)).bit_length()
    while step < 4 and bits <= 31:  # two characters' ranks fit one key without sorting in between
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        rank = (rank << bits) | ahead
        step, bits = 2 * step, 2 * bits
    if step > 1:
        order = np.argsort(rank)
        ordered = rank[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        if step >= width or fresh.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key)
        step *= 2
        ordered = key[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        if step >= width or fresh.all():
            return order
        rank[order] = np.cumsum(fresh)


def occurrences(codes: np.ndarray, order: np.ndarray, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of chars its range [low, high) in the suffix array, by binary search on all rows at once."""
    n = len(order)
    padded = np.concatenate([codes, np.zeros(chars.shape[1], codes.dtype)])
    low, high = np.zeros(len(chars), np.int64), np.full(len(chars), n)
    for depth in range(chars.shape[1]):
        live = np.flatnonzero((length > depth) & (low < high))
        if not len(live):
            break
        want = chars[live, depth]

        def bound(strict: bool, live=live, want=want, depth=depth):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    return a
                mid = (a + b) >> 1
                got = padded[order[np.minimum(mid, n - 1)] + depth]
                less = open_ & ((got <= want) if strict else (got < want))
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)

        begin, end = bound(False), bound(True)
        low[live], high[live] = begin, end
    return low, high


def apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of pieces (ranks): would merging leave the border between them alone?"""
    size = len(v.length)
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b, limit = a.copy(), b.copy(), np.full(len(a), _NEVER)
    while len(live):
        key = a * size + b
        at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
        over = np.where(v.pair_key[at] == key, v.pair_rank[at], _NEVER)
        bad = over < limit
        out[live[bad]] = False
        # undo the later of the two merges; a character has none to undo
        can_a, can_b = v.left[a] != a, v.left[b] != b
        undo_a = can_a & (~can_b | (a > b))
        undo_b = can_b & ~undo_a
        limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
        a = np.where(undo_a, v.right[a], a)
        b = np.where(undo_b, v.left[b], b)
        on = ~bad & (undo_a | undo_b)
        live, a, b, limit = live[on], a[on], b[on], limit[on]
    return out


def _run(v: Vocabulary, m: int) -> list[int]:
    """Ids of m spaces: pieces of spaces share one score, so the leftmost pair that makes a piece merges first.

    Nothing on the stack can merge, so the leftmost pair is always its top and the next space.
    """
    parts: list[int] = []
    for _ in range(m):
        parts.append(1)
        while len(parts) > 1 and parts[-2] + parts[-1] in v.runs:
            parts[-2:] = [parts[-2] + parts[-1]]
    return [v.runs[p] for p in parts]


def _relax(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encodings of parts, each on its own: ranks, where each piece starts in its part, and len+1 bounds into both."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes)
    size = np.array([len(c) for c in parts])
    begin = np.cumsum(size) - size
    order = suffix_array(codes, v.chars.shape[1])
    count = len(v.length) - 1
    low, high = occurrences(codes, order, v.chars[:count], v.length[:count])
    times = high - low
    piece = np.repeat(np.arange(count, dtype=np.int32), times)
    at = np.arange(len(piece))
    at -= np.repeat(np.cumsum(times) - times - low, times)
    start = order.astype(np.int32)[at]
    del order, at, codes
    known = np.zeros(n, bool)
    known[start[piece < np.count_nonzero(v.length[:count] == 1)]] = True  # characters have the first ranks
    lone = np.flatnonzero(~known).astype(np.int32)
    piece, start = np.concatenate([piece, np.full(len(lone), count, np.int32)]), np.concatenate([start, lone])
    offset = (np.arange(n) - np.repeat(begin, size)).astype(np.int32)  # of each character in its part
    level = start + v.length.astype(np.int32)[piece]
    level -= 1
    level = offset[level]
    level += 1
    by = np.argsort(level.astype(np.uint16) if level.max() < 1 << 16 else level, kind="stable")
    piece, start, level = piece[by], start[by], level[by]
    steps = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
    del by, level
    last, came = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)  # at each position after a character: its last piece and where that starts
    for k in range(len(steps) - 1):
        here = slice(steps[k], steps[k + 1])
        p, s = piece[here], start[here]
        at_start = offset[s] == 0
        before = np.where(at_start, count, last[s])
        ok = at_start | apart(v, before, p)
        p, s = p[ok], s[ok]
        e = s + v.length[p]
        last[e], came[e] = p, s
    del piece, start
    # walk back from all ends at once
    at, alive, back = begin + size, np.arange(len(parts)), []
    while len(alive):
        back.append((alive, last[at], came[at]))
        at = came[at]
        on = at > begin[alive]
        alive, at = alive[on], at[on]
    owner = np.concatenate([b[0] for b in back])
    ranks, place = np.concatenate([b[1] for b in back]), np.concatenate([b[2] for b in back])
    by = np.lexsort((place, owner))
    owner = owner[by]
    return ranks[by], place[by] - begin[owner], np.searchsorted(owner, np.arange(len(parts) + 1))


def _windows(core: str) -> list[str]:
    """core in windows of STEP characters and OVERLAP more."""
    return [core[a : a + STEP + OVERLAP] for a in range(0, len(core) - OVERLAP, STEP)]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """One encoding from those of the windows, or None where two neighbours have no token in common."""
    ranks, place = [], []
    first = 0  # of the window's tokens, the first one not taken yet
    for k, (r, s) in enumerate(parts[:-1]):
        r2, s2 = parts[k + 1]
        # a token is common if both windows have its piece at its place
        here, there = s - STEP, s2
        _, i, j = np.intersect1d(here[:-1], there, assume_unique=True, return_indices=True)
        same = (r[i] == r2[j]) & (i >= first)
        if not same.any():
            return None
        i, j = int(i[same][0]), int(j[same][0])
        ranks.append(r[first : i + 1])
        place.append(s[first : i + 1] + k * STEP)
        first = j + 1
    r, s = parts[-1]
    return np.concatenate([*ranks, r[first:]]), np.concatenate([*place, s[first:] + (len(parts) - 1) * STEP])


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """Ids (int32, as bytes) of pre-tokens; each is what follows the space that the library puts first."""
    cores = [SPACE + w.lstrip(" ") for w in words]
    long = {i: _windows(c) for i, c in enumerate(cores) if len(c) > LONG}
    parts = [x for i, c in enumerate(cores) for x in long.get(i, (c,))] if long else cores
    ranks, place, bounds = _relax(v, parts)
    ids = v.ids[ranks]
    blob = ids.astype(np.int32).tobytes()
    count = np.ones(len(words), np.int64)
    count[list(long)] = [len(x) for x in long.values()]
    first = np.cumsum(count) - count
    begin, end = bounds[first], bounds[first + count]
    out = [blob[a:b] for a, b in zip((4 * begin).tolist(), (4 * end).tolist(), strict=True)]
    lone = np.concatenate(([0], np.cumsum(ids < 0)))
    spaces = np.array([len(w) + 1 - len(c) for w, c in zip(words, cores, strict=True)])
    for i in sorted({*np.flatnonzero((spaces > 0) | (lone[begin] < lone[end])).tolist(), *long}):
        r, s, m = ranks[begin[i] : end[i]], place[begin[i] : end[i]], int(spaces[i])
        if i in long:
            at = range(first[i], first[i] + count[i])
            whole = _joined([(ranks[bounds[k] : bounds[k + 1]], place[bounds[k] : bounds[k + 1]]) for k in at])
            r, s = whole if whole is not None else _relax(v, [cores[i]])[:2]
        mine = []
        for x, q in zip(v.ids[r].tolist(), s.tolist(), strict=True):
            mine += [x] if x >= 0 else [v.byte_ids[c] for c in cores[i][q].encode()]
        if m:
            mine = _run(v, m + 1) + mine[1:] if mine[0] == v.runs[1] else _run(v, m) + mine
        out[i] = np.array(mine, np.int32).tobytes()
    return out


def _blocks(words: list[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for w in words:
        if block and chars + len(w) + 1 > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(w)
        chars += len(w) + 1
    if block:
        yield block


class Encoder:
    """Encodes the texts of a batch through their distinct pre-tokens."""

    def __init__(self, path: str):
        self.v = vocabulary(path)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        one: dict[str, str] = {}  # a pre-token that stands in many places is held once
        split = [[one.setdefault(w, w) for w in pretokens(t)] if t else [] for t in texts]
        known: dict[str, bytes] = {}
        for block in _blocks(list(one)):
            known.update(zip(block, encode_words(self.v, block), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encoder(path: str):
    """A function of a text column: its ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(text: pa.Array) -> pa.Array:
        run, parts = Encoder(path), []
        for a, n in common.slices(text, BATCH_BYTES):
            parts += run(text.slice(a, n).to_pylist())
        return _lists(parts)

    return encode


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """Text of ids; the space that encoding put first is taken off."""
    text = b"".join([v.raw[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def decode_all(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of the rows ids[offsets[i]:offsets[i + 1]], their bytes gathered at once; rows that are no UTF-8 are decoded one by one."""
    size = v.raw_size[ids]
    ends = np.cumsum(size)
    data = v.raw_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(v.raw_start[ids] - ends + size, size)]
    bound = np.concatenate(([0], ends))[offsets]
    drop = bound[:-1][bound[:-1] < bound[1:]]  # the first byte of each row that has one
    drop = drop[data[drop] == 0x20]
    bound = bound - np.searchsorted(drop, bound)
    data = np.delete(data, drop)
    text = pa.StringArray.from_buffers(len(bound) - 1, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(data))
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)], pa.string())
    return text


def decoder(path: str):
    """A function of a column of ids: their text."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        v, parts = vocabulary(path), []
        sizes = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
        for a, n in _portions(sizes):
            rows = ids.slice(a, n)
            at = np.concatenate(([0], np.cumsum(sizes[a : a + n])))
            text = decode_all(v, rows.flatten().to_numpy(), at)
            parts.append(pc.if_else(rows.is_valid(), text, None) if rows.null_count else text)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode


def _portions(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges (start, count) of at most `most` ids each, but one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


_ROUND = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def both_ways(path: str):
    """A function of a text column: its ids and the text that they decode to.

    One function, for the optimizer computes a chain of two Python functions as one
    call that encodes again inside of it.
    """

    @F.arrow_udf(_ROUND)
    def there_and_back(text: pa.Array) -> pa.Array:
        run, v, ids, texts = Encoder(path), vocabulary(path), [], []
        for a, n in common.slices(text, BATCH_BYTES):
            rows = _lists(run(text.slice(a, n).to_pylist()))
            ids.append(rows)
            texts.append(decode_all(v, rows.values.to_numpy(), np.asarray(rows.offsets)))
        empty = pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())
        return pa.StructArray.from_arrays([pa.concat_arrays(ids) if ids else empty[0], pa.concat_arrays(texts) if texts else empty[1]], ["ids", "decoded"])

    return there_and_back


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text in ids_col (a name that docs lacks is made from it)."""
    common.small_batches(docs.sparkSession)
    (name,) = common.fresh(docs, ids_col)
    return docs.withColumn(name, encoder(path)(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of ids_col; null ids give null."""
    common.small_batches(rows.sparkSession)
    (name,) = common.fresh(rows, text_col)
    return rows.withColumn(name, decoder(path)(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded_sha256, and whether decoding gives the text again."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    back = rows.select("doc_id", "text", both_ways(path)(F.col("text")).alias("r")).select("doc_id", "text", "r.*")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))
