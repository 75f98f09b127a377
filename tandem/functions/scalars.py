"""Column functions: lenient coercion, identifiers, dates, rates and text clean-up.

All are expressions over Columns; ``plain_name`` alone needs Python (Unicode
decomposition) and is an Arrow function.
"""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats tried by `as_date`, in order (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "MMM d, yyyy")
#: Identifier texts that mean no identifier (fixed values).
NO_ID = ("", "nan", "None", "<NA>")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def lenient_double(c: Column) -> Column:
    """A finite number or null: blanks, words, NaN and infinities are null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def strict_double(c: Column, default: float = 0.0) -> Column:
    """A number; blank is the default, and what is no finite number raises."""
    x = lenient_double(c)
    blank = c.isNull() | (F.trim(c.cast("string")) == "")
    return F.when(blank, F.lit(default)).when(x.isNull(), F.raise_error(F.concat(F.lit("not a finite number: "), c.cast("string"))).cast("double")).otherwise(x)


def lenient_long(c: Column) -> Column:
    """A number within 1e-6 of an integer as that integer, else null."""
    x = lenient_double(c)
    return F.when(F.abs(x - F.round(x)) <= 1e-6, F.round(x).cast("long"))


def clean_id(c: Column) -> Column:
    """A trimmed identifier without a final `.0`; the texts of NO_ID become empty."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(c.isNull() | text.isin(*NO_ID), F.lit("")).otherwise(text)


def first_filled(*columns: Column, default: str = "") -> Column:
    """The first column with an identifier in it."""
    return F.coalesce(*[F.nullif(clean_id(c), F.lit("")) for c in columns], F.lit(default))


def first_finite(*columns: Column) -> Column:
    return F.coalesce(*[lenient_double(c) for c in columns])


def as_date(c: Column) -> Column:
    """A date in one of four formats, read from the first 19 characters."""
    text = F.substring(F.trim(c.cast("string")), 1, 19)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])


def season_label(start_year: Column) -> Column:
    """2001 -> 2001-02"""
    return F.concat_ws("-", start_year.cast("string"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def season_start(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int")


def season_bounds(start_year: Column) -> tuple[Column, Column]:
    """First and last day of a season; two seasons were irregular (fixed values)."""
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    first = F.when(start_year == 2020, day(start_year, 12, 1)).otherwise(day(start_year, 10, 1))
    last = F.when(start_year == 2019, day(start_year + 1, 8, 31)).when(start_year == 2020, day(start_year + 1, 5, 31)).otherwise(day(start_year + 1, 4, 30))
    return first, last


def share(c: Column) -> Column:
    """Rates above 1.5 are taken for percentages."""
    return F.when(c > 1.5, c / 100).otherwise(c)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where either is missing or whole is 0."""
    return F.try_divide(100.0 * part, F.nullif(whole, F.lit(0.0)))


def elapsed_seconds(period: Column, clock: Column, regular: int = 720, extra: int = 300) -> Column:
    """Seconds from the start at `mm:ss` left of a period; four regular periods, then extra ones."""
    left = F.split(clock, ":")[0].cast("int") * 60 + F.split(clock, ":")[1].cast("int")
    before = F.when(period <= 4, (period - 1) * regular).otherwise(4 * regular + (period - 5) * extra)
    return before + F.when(period <= 4, regular).otherwise(extra) - left


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer text's length: 0 for equal texts, 1 for nothing in common."""
    return F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def slug(c: Column) -> Column:
    """camelCase and punctuation to lower_case; `field` when nothing is left."""
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    bare = F.lower(F.regexp_replace(F.regexp_replace(spaced, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(bare == "", "field").otherwise(bare)


def request_key(endpoint: Column, parameters: Column) -> Column:
    """A key for a landed response: endpoint and sorted parameters (a map), hashed."""
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat_ws("=", e["key"], F.url_encode(e["value"])))
    return F.sha2(F.concat_ws("?", endpoint, F.array_join(pairs, "&")), 256)


@F.arrow_udf(T.StringType())
def plain_name(name: pa.Array) -> pa.Array:
    """Decomposed, without combining marks, case-folded and trimmed."""
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold().strip()
    return pa.array([None if s is None else bare(s) for s in name.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """The common HTML entities, and references to characters by number; `&amp;` last, so nothing is unescaped twice."""
    number = lambda ref: F.when(ref.startswith("x") | ref.startswith("X"), F.conv(F.substring(ref, 2, 8), 16, 10)).otherwise(F.substring(ref, 1, 8)).cast("long")
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit("&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1)))
    shown = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    real = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    pairs = F.filter(F.transform(refs, lambda r: F.struct(r.alias("ref"), number(r).alias("n"))), lambda p: real(p["n"]))
    c = F.aggregate(pairs, c, lambda acc, p: F.replace(acc, F.concat(F.lit("&#"), p["ref"], F.lit(";")), shown(p["n"])))
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "–"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(c), r"\s+", " "))


def strip_html(c: Column) -> Column:
    """Text without script and style blocks and tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    return clean_text(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def uncomment_tables(c: Column) -> Column:
    """Tables that a page hides in comments, laid open."""
    return F.regexp_replace(c, r"(?s)<!--((?:(?!-->).)*<table(?:(?!-->).)*)-->", "$1")


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit('<a[^>]* href="([^"]*)"'), F.lit(1))


def date_hint(*texts: Column) -> Column:
    """`Month d` of the first text that names a day."""
    pattern = rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}})\b"
    one = lambda t: F.when(F.regexp_extract(t, pattern, 1) != "", F.concat_ws(" ", F.initcap(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2).cast("int").cast("string")))
    return F.coalesce(*[one(t) for t in texts])


def phrase_gap(text: Column, phrases: list[str], most: int = 700) -> Column:
    """Do the phrases follow one another with at most `most` characters between?"""
    return text.rlike("(?is)" + f".{{0,{most}}}".join(phrases))


def first_match(text: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The value of the first rule of which one token stands in text."""
    case = F.when(F.lit(False), F.lit(default))
    for tokens, value in rules:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | text.contains(token)
        case = case.when(hit, F.lit(value))
    return case.otherwise(F.lit(default))


#: Transaction verbs, first match wins; texts are padded with a space on either side (fixed values).
TRANSACTIONS = [
    ((" traded ",), "Trades"),
    ((" signed ",), "Signings"),
    ((" waived ",), "Waived"),
    ((" released ",), "Released"),
    ((" claimed ",), "Claimed"),
    ((" activated ",), "Activated"),
    (("injured list",), "Injured list"),
]
#: Metric families by name, first match wins (fixed values).
FAMILIES = [
    (("rebound",), "rebounding"),
    (("shot", "fieldgoal", "three", "free", "efg", "true shooting"), "shooting"),
    (("turnover", "assist", "possession", "pace"), "possession/playmaking"),
    (("point", "rating", "score"), "scoring/efficiency"),
    (("foul", "block", "steal"), "defence/discipline"),
]
#: Tokens of counted metrics (fixed values).
COUNTED = ("rebounds", "assists", "turnovers", "points", "attempts", "makes", "blocks", "steals", "fouls")


def transaction_kind(text: Column) -> Column:
    return first_match(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), TRANSACTIONS, "Other")


def metric_family(name: Column) -> Column:
    return first_match(F.lower(name), FAMILIES, "other")


#: What to do with a metric of each unit (fixed values).
GUIDANCE = {
    "percentage/share": "Prefer component-count recomputation; otherwise use a clearly labelled weighted mean.",
    "rate/rating": "Prefer possession weighting; package career summaries use minutes weighting.",
    "count": "Sum only across non-overlapping segments.",
    "metric-dependent": "Check pbpstats definition before interpreting or aggregating.",
}


def metric_guidance(name: Column) -> Column:
    """How a metric may be aggregated, by its unit."""
    unit, case = metric_unit(name), None
    for key, text in GUIDANCE.items():
        case = F.when(unit == key, text) if case is None else case.when(unit == key, text)
    return case


def metric_unit(name: Column) -> Column:
    low = F.lower(name)
    counted = F.lit(False)
    for token in COUNTED:
        counted = counted | low.contains(token)
    return (
        F.when(low.endswith("pct") | low.contains("percentage") | low.contains("frequency"), "percentage/share")
        .when(low.contains("rating") | low.contains("per100"), "rate/rating")
        .when(counted, "count")
        .otherwise("metric-dependent")
    )


def name_of_era(key: Column, year: Column, eras: list[tuple[int, int, int, str]], current: Column) -> Column:
    """The name that a key had in a year: the first of eras (key, first year, last year, name) that holds, else the current one."""
    case = F.when(F.lit(False), current)
    for k, first, last, name in eras:
        case = case.when((key == k) & year.between(first, last), F.lit(name))
    return case.otherwise(current)


def field(fields: Column, name: str) -> Column:
    """A value of a map by name, whatever the case."""
    return F.element_at(F.transform_keys(fields, lambda k, _: F.lower(k)), name.lower())


def without(fields: Column, *names: str) -> Column:
    """A map less some keys, whatever their case."""
    gone = [n.lower() for n in names]
    return F.map_filter(fields, lambda k, _: ~F.lower(k).isin(gone))


def plain_number(text: Column) -> Column:
    """`+1,234` as a number; null where there is none."""
    return F.translate(text, ",+", "").try_cast("double")


def strict_day(text: Column) -> Column:
    """Is the text a day, `Month d, yyyy`, and nothing else?"""
    return text.rlike(rf"^(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}$")


def wiki_label(start_year: Column) -> Column:
    """2001 -> 2001–02, with an en dash"""
    return F.concat(start_year.cast("string"), F.lit("–"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def full_name(first: Column, last: Column, other: Column) -> Column:
    """First and last name, or the other name where both are blank."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit("")))), F.lit("")), other)


def bounds_of(text: Column) -> tuple[Column, Column]:
    """Least and greatest number of a JSON array; nulls where the text is none."""
    numbers = F.from_json(text, "array<double>")
    return F.array_min(numbers), F.array_max(numbers)


def round_half_even(x: Column, digits: int) -> Column:
    """Rounds the number as it is printed, halves to even: 0.125 becomes 0.12 and 2.675 becomes 2.68."""
    return F.bround(x.cast("decimal(38,18)"), digits).cast("double")


def round_binary(x: Column, digits: int) -> Column:
    """Rounds the value that the double really has, halves to even: 0.125 becomes 0.12 and 2.675, which is a little less, 2.67.

    A double is a whole number of 2^-k; that number and the middle between two results
    are compared as whole numbers.  Numbers of 2^44 and more stay as they are, those under
    1e-6 become 0, and digits must be at most 4.
    """
    size = F.abs(x)
    k = F.least(F.lit(52 + 20), F.greatest(F.lit(0), F.lit(52) - F.floor(F.log2(F.greatest(size, F.lit(1e-6)))))).cast("int")
    whole = F.round(size * F.pow(F.lit(2.0), k)).cast("decimal(20,0)").cast("decimal(26,0)")  # exact: 53 bits at most
    one = F.pow(F.lit(2.0), k).cast("decimal(26,0)")
    scaled = whole * F.lit(10**digits).cast("decimal(6,0)")
    low = F.call_function("div", scaled, one).cast("decimal(20,0)")
    twice = 2 * (scaled - (low * one).cast("decimal(32,0)"))
    up = (twice > one) | ((twice == one) & (low % 2 == 1))
    near = ((low + F.when(up, 1).otherwise(0)).cast("decimal(21,0)") * F.lit(Decimal(1).scaleb(-digits)).cast(f"decimal(6,{digits})")).cast("double")
    out = F.when(size < 1e-6, F.lit(0.0)).when(size >= 2.0**44, size).otherwise(near)
    return F.when(x < 0, -out).otherwise(out)
