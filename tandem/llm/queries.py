"""The corpus operators applied to the fixture tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import collocations, conversations, language_id, mixing, ngram_join, order_minhash, passages, piece_lattice, quality_rules, secrets, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; they stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE_MODEL = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) from the labels: toxic, else poor or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


#: Shares of tokens by domain.
TARGETS = {"clean": 0.90, "poor": 0.07, "toxic": 0.03}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


#: A dated block and allow list over the hosts of the fixture (fixed values, in natural order).
LISTED = (
    ("domain", "example.net", "block", "2024-01-20 00:00:00"),
    ("domain", "example.net", "remove", "2024-01-22 12:00:00"),
    ("domain", "spam-farm.example.org", "block", "2023-12-01 00:00:00"),
    ("domain", "cheap-pills.example.com", "block", "2024-01-03 06:00:00"),
    ("domain", "cheap-pills.example.com", "remove", "2024-01-12 00:00:00"),
    ("domain", "cheap-pills.example.com", "block", "2024-01-18 00:00:00"),
    ("host", "www.cheap-pills.example.com", "allow", "2024-01-19 00:00:00"),
    ("host", "www.cheap-pills.example.com", "remove", "2024-01-25 00:00:00"),
    ("prefix", "spam-farm.example.org/en", "allow", "2024-01-10 00:00:00"),
    ("prefix", "www.cheap-pills.example.com/fr", "block", "2024-01-21 00:00:00"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; each gets one in January 2024 from its id, 37 minutes apart, around 30 days."""
    seconds = F.pmod(F.col("page_id") * 2220, F.lit(30 * 86400))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).cast("timestamp_ntz").alias("fetched_at"))
    entries = spark.createDataFrame(LISTED, "scope string, pattern string, action string, listed_at string")
    return url_filter.judge(captures, entries)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.by_document(passages.repeated_passages(_table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are damaged by the checksum of their turns and then repaired."""
    given = _table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damage(given), given)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, by the checksum of their id, is held out."""
    return language_id.predict(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_toxicity, op2_mixing, op3_token_counts, op4_url_filter, op5_order_minhash,
        op6_ngram_join, op7_quality_rules, op8_passages, op9_secret_scan, op10_sentencepiece, op11_conversation_repair, op12_collocations, op13_language_id,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """SQL for the corpus queries that DuckDB can express; the others are tested against brute force."""
    rows = ", ".join(f"('{s}', '{p}', '{a}', TIMESTAMP '{t}')" for s, p, a, t in LISTED)
    return {"op4_url_filter": URL_SQL.replace("{rows}", rows), "op11_conversation_repair": REPAIR_SQL, "op12_collocations": PHRASE_SQL}


URL_SQL = """
WITH log(scope, pattern, action, valid_from) AS (VALUES {rows}),
spans AS (
  SELECT scope, pattern, action, valid_from, lead(valid_from, 1, TIMESTAMP '9999-12-31') OVER (PARTITION BY scope, pattern ORDER BY valid_from) AS valid_to FROM log
),
parts AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_seconds(((page_id * 2220) % 2592000)::BIGINT) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 1)), '\\.$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 2), '/+$', '') AS path
  FROM pages
),
met AS (
  SELECT page_id, action, scope || ':' || pattern AS key,
    CASE scope WHEN 'url' THEN 3000 WHEN 'prefix' THEN 2000 + len(string_split(pattern, '/')) WHEN 'host' THEN 1000 ELSE len(string_split(pattern, '.')) END AS width
  FROM parts JOIN spans ON valid_from <= fetched_at AND fetched_at < valid_to AND CASE scope
    WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
    WHEN 'host' THEN host = pattern
    WHEN 'url' THEN lower(host || path) = pattern
    ELSE lower(host || path) = pattern OR starts_with(lower(host || path), pattern || '/') END
),
best AS (
  SELECT page_id, key, action FROM met
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY width DESC, (action = 'allow') DESC, key DESC) = 1
)
SELECT p.page_id, p.host, p.fetched_at,
  CASE WHEN p.host = '' THEN 'invalid' WHEN b.action = 'block' THEN 'blocked' WHEN b.action = 'allow' THEN 'allowed' ELSE 'kept' END AS status, b.key AS entry
FROM parts p LEFT JOIN best b USING (page_id)
"""

#: Pieces, their words, and all phrases of one to three words, counted; exact arithmetic in 128 bits.
PHRASE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE k = 3) GROUP BY ALL
),
kept AS (SELECT cand.* FROM cand LEFT JOIN longer ON cand.lang = longer.lang AND cand.phrase = longer.phrase WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, ws[1] AS p, array_to_string(ws[2:], ' ') AS q FROM kept
  UNION ALL SELECT lang, k, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM kept WHERE k = 3
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN c x ON x.lang = cuts.lang AND x.phrase = p JOIN c y ON y.lang = cuts.lang AND y.phrase = q
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""

#: The checksum bit by bit, the damage, the faults, and the repair as a shortest path: one round a turn, four states.
REPAIR_SQL = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)), CAST(4294967295 AS UBIGINT)) % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, (VALUES (1), (2)) copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) AS nth, left(role, 1) AS ini,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS open
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM damaged))
),
t AS (
  SELECT *, blank OR nth > 1 AS gone, CASE WHEN NOT blank AND nth = 1 AND open THEN 1 ELSE 0 END AS extra,
    coalesce(lag(ini) OVER (PARTITION BY c ORDER BY pos) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM r
),
ins(f, m, fee, mark) AS (VALUES ('n', 'n', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('n', 'u', 2, 'I'), ('s', 'u', 2, 'I'), ('a', 'u', 2, 'I'), ('u', 'a', 2, 'I')),
ops(m, s, edit, wants, price) AS (VALUES ('n', 'n', 'D', '', 3), ('s', 's', 'D', '', 3), ('u', 'u', 'D', '', 3), ('a', 'a', 'D', '', 3),
  ('n', 's', 'K', 's', 0), ('n', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0), ('n', 'u', 'R', '', 2), ('s', 'u', 'R', '', 2), ('a', 'u', 'R', '', 2), ('u', 'a', 'R', '', 2)),
best AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS pos, 'n' AS s, '000000000' AS path FROM t
  UNION ALL
  SELECT b.c, t.pos, ops.s, min(lpad(CAST(CAST(left(b.path, 9) AS INTEGER) + fee + price + CASE WHEN edit = 'D' THEN 0 ELSE extra END AS VARCHAR), 9, '0') || b.path[10:] || mark || edit)
  FROM best b JOIN t ON t.c = b.c AND t.pos = b.pos + 1 JOIN ins ON ins.f = b.s JOIN ops ON ops.m = ins.m AND (edit = 'D' OR NOT gone) AND (wants = '' OR wants = ini)
  GROUP BY b.c, t.pos, ops.s
),
ends AS (SELECT c, max(pos) AS pos FROM t GROUP BY c),
final AS (
  SELECT c, min(lpad(CAST(CAST(left(path, 9) AS INTEGER) + fee AS VARCHAR), 9, '0') || path[10:] || mark) AS path FROM best JOIN ends USING (c, pos) JOIN ins ON ins.f = best.s AND ins.m IN ('n', 'a') GROUP BY c
),
edits AS (SELECT c, i, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY c ORDER BY i) AS pos FROM (SELECT c, unnest(string_split(path[10:], '')) AS edit, unnest(range(len(path) - 9)) AS i FROM final)),
left_over AS (
  SELECT e.c, e.edit, e.i, t.role, CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY e.c ORDER BY i) AS j,
    first_value(edit = 'K' AND ini = 's') OVER (PARTITION BY e.c ORDER BY i) AS system FROM edits e LEFT JOIN t ON t.c = e.c AND t.pos = e.pos WHERE edit <> 'D'
),
said AS (
  SELECT c, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j % 2 = 1) = system THEN 'assistant' ELSE 'user' END || ':' || text, chr(10) ORDER BY i)) AS digest FROM left_over GROUP BY c
),
counts AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND nth > 1) AS duplicate,
    CAST(sum(extra) AS BIGINT) AS truncated, count(*) FILTER (bad) AS illegal FROM t GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(path, 9) AS BIGINT), 0) AS cost, coalesce(path[10:], '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final USING (c) LEFT JOIN said USING (c)
"""
