"""Secret scans: fixed patterns, and strings that zstandard cannot explain.

Three base kinds are plain patterns (``assign``, ``access``, ``hex``).  The
fourth, ``novel``, takes every long mixed string in whose surroundings a
sensitive word stands, and measures how many bytes it adds when it is compressed
after its surroundings with a compressor primed by a dictionary of code and
identifier text.  Words, paths and repeats of the surroundings add few bytes; a
key adds nearly as many as it has characters of entropy.

Surroundings are WINDOW characters before a string and half as many after it, so a
sensitive word further off does not make a string a secret.  Strings have no greatest
length: long ones are weighed in chunks, dotted ones by their parts too.

Offsets are code points, ends exclusive.  Defined edge cases: a null or empty
text has no spans; repeated rows are scanned one by one; a ``novel`` span that
a base span covers is not reported again; other columns pass through.  Strings that
adjoin a novel one (the next lines of a key) are as sensitive as it is, and the body
of a private key is taken whole up to its end line.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Strings worth weighing: 16 or more characters of a key's alphabet, dots between them, a letter and a digit among them.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: The body of a private key, and what may stand between lines of one key.
PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
BETWEEN = re.compile(r"""(?:\\[nrt]?|[\s"'+,;])*""")
#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"secret|token|passw|api.?key|access.?key|private.?key|credential|auth|bearer|signature|client.?id|AKIA|ssh-|-----BEGIN", re.IGNORECASE | re.ASCII)
#: Identifier and code text that primes the compressor (fixed values, in natural order).
DICTIONARY = """
abstract access account address algorithm alias allocate annotation api application argument array assert async attribute
authorization await base64 binary boolean branch browser buffer build button bytes cache callback catch channel char class
client close cloud code collection column command commit common compare compile component config configuration connect
connection console const constant constructor container content context continue control convert cookie copy count create
credential cursor custom data database date debug decode default define delete deploy description dictionary directory
document domain double download driver dynamic element else email enable encode encoding encrypt endpoint engine enum error
event example except exception execute expect export expression extends false field file filter final float folder format
from function generate get global graph group handler hash header height hello host http https identifier image implements
import index info init input insert instance int integer interface internal iterator java javascript job json key lambda
language length library license line link list listener load local location lock log login long loop main manager map match
member memory message metadata method model module monitor mutable name namespace native network new node none null number
object offset open operation option output override package page parameter parse partition password path pattern payload
permission pipeline pointer policy port prefix print private process profile project property protected protocol provider
proxy public query queue random read receive record reference region register release remote remove render replace request
resource response result return role root route runtime save schema scope script search secret security select self send
sequence server service session setting shared signature size socket source span stack start state static status storage
stream string struct style subscribe suffix super switch sync system table target task template test text thread throw time
timeout timestamp title token trace transaction transform true try type undefined update upload url user username utf8 uuid
validate value variable vector version view virtual void volume while width window worker write xml yaml
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https://www.example.com/index.html?id=
def main(self): return None; public static void function(const char* argument) { if (value == null) { throw new Error(); } }
import os import sys from typing import Any; SELECT * FROM table WHERE id = 1; <div class="container"></div> /usr/local/bin
""".encode()
WINDOW = 96
#: Characters of a long candidate that are weighed at a time.
CHUNK = 512
#: A candidate is reported when it adds at least this share of its own bytes.
MIN_NOVELTY = 0.60


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, level: int = 3):
        primer = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, around: str, candidate: str) -> float:
        before = around.encode("utf-8", "replace")
        word = candidate.encode("utf-8", "replace")
        return (len(self.zip.compress(before + word)) - len(self.zip.compress(before))) / max(1, len(word))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the three base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


#: A maximal run of 24 or more is the same as a run by HEX that has 24 or more.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _mixed(word: str) -> bool:
    return len(word) >= 16 and DIGIT.search(word) is not None and LETTER.search(word) is not None


def _novel(text: str, a: int, b: int, near: str, novelty: Novelty, least: float) -> bool:
    """Whether the string a..b, one of its parts between dots, or a chunk of a long one is novel."""
    word = text[a:b]
    if not _mixed(word):
        return False
    parts = [word, *word.split(".")] if "." in word else [word]
    return any(novelty(near, x[i : i + CHUNK]) >= least for x in parts if _mixed(x) for i in range(0, len(x), CHUNK) if _mixed(x[i : i + CHUNK]))


def _private_keys(text: str) -> list[tuple[int, int]]:
    """Runs in the bodies of private keys that have an end line, however short the last one is."""
    out, end = [], 0
    for m in PRIVATE.finditer(text):
        stop = text.find("-----END", m.end())
        if stop < 0:
            break
        if m.end() >= end:
            runs = [r.span() for r in RUN.finditer(text, m.end(), stop)]
            big = next((i for i, (a, b) in enumerate(runs) if b - a >= 16), len(runs))
            out += runs[big:]
            end = stop
    return out


class _Cover:
    """What the base spans, in order of their starts, say about a stretch of text."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [x for x, _, _ in base]
        self.reach = list(accumulate((y for _, _, y in base), max))  # the furthest end of the spans so far

    def met(self, a: int, b: int) -> tuple[int, int] | None:
        """The least start and the greatest end of the spans that overlap a..b."""
        n = bisect_left(self.starts, b)
        first = bisect_right(self.reach, a, 0, n)
        return (self.starts[first], self.reach[n - 1]) if first < n else None

    def holds(self, a: int, b: int) -> bool:
        """Whether one span covers a..b."""
        n = bisect_right(self.starts, a)
        return n > 0 and self.reach[n - 1] >= b


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = MIN_NOVELTY) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the strings that are novel where they stand, and of the bodies of private keys."""
    out = []
    if not SENSITIVE.search(text):
        return out
    keys = _private_keys(text) if "-----BEGIN" in text else []
    cover, inside = _Cover(base), iter(keys)
    key = next(inside, None)
    last = None  # where the last novel string ended: strings that adjoin it are as sensitive
    for m in CANDIDATE.finditer(text):
        word = m[0].strip(".")
        if len(word) < 16:
            continue
        a = m.start() + m[0].index(word)
        b = a + len(word)
        while key and key[1] <= a:
            key = next(inside, None)
        if key and key[0] < b:
            continue  # taken whole below
        over = cover.met(a, b)
        # a base span takes the string; one that reaches beyond it is weighed as a whole
        if over and over[1] >= b and over[0] - a < 16:
            continue
        near = text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW // 2]
        carried = last is not None and a - last <= WINDOW and BETWEEN.fullmatch(text, last, a) is not None
        if (carried or SENSITIVE.search(near)) and _novel(text, a, b, near, novelty, least):
            out.append((a, 3, b))
            last = b
    out += [(a, 3, b) for a, b in keys if not cover.holds(a, b)]
    return sorted(out)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_novel")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")])


def _texts(text: pa.Array) -> Iterator[str]:
    for a, n in common.slices(text):
        for x in text.slice(a, n).to_pylist():
            yield x or ""


@F.arrow_udf(_FOUND)
def find(text: pa.Array) -> pa.Array:
    novelty, rows = Novelty(), []
    for x in _texts(text):
        base = base_spans(x)
        kinds = [k for _, k, _ in base]
        more = novel_spans(x, base, novelty)
        rows.append((*(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more)))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)], [f.name for f in _FOUND])


@F.arrow_udf(T.StringType())
def redacted(text: pa.Array) -> pa.Array:
    novelty, out = Novelty(), []
    for raw, x in zip(text.is_null().to_pylist(), _texts(text), strict=True):
        base = base_spans(x)
        end, parts = 0, []
        for a, k, b in sorted(base + novel_spans(x, base, novelty)):
            if a >= end:
                parts += [x[end:a], f"[{KINDS[k]}]"]
            end = max(end, b)
        out.append(None if raw else "".join([*parts, x[end:]]))
    return pa.array(out, pa.string())


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans and all spans."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), find(F.col(text_col)).alias("_found"))
    return rows.select("doc_id", *[F.col(f"_found.{c}") for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span found replaced by its kind in brackets, and n_chars counted anew."""
    common.small_batches(docs.sparkSession)
    out = docs.withColumn(text_col, redacted(F.col(text_col)))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
