"""Text and matching queries over pages, documents, events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import matching, onoff, textops, variants
from tandem.plans.registry import query
from tandem.sources.tables import table


@query("""WITH p AS (SELECT p_partkey, p_name, lower(strip_accents(p_name)) AS k FROM part),
ix AS (SELECT k, min(p_name) AS name FROM p GROUP BY k HAVING count(DISTINCT p_name) = 1)
SELECT p_partkey, p_name, ix.name AS resolved FROM p LEFT JOIN ix ON p.k = ix.k""")
def q_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts to the one part of their plain name; names that several parts share resolve to nothing."""
    p = table(spark, d, "part").select("p_partkey", "p_name", S.plain_name("p_name").alias("k"))
    index = onoff.ambiguous_free_index(p.withColumnRenamed("p_name", "resolved"), "k", "resolved")
    return p.join(index, "k", "left").select("p_partkey", "p_name", "resolved")


@query("""WITH w AS (SELECT doc_id, replace(lower(strip_accents(text)), 'ß', 'ss') AS plain FROM documents) SELECT doc_id, trim(plain, ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM w""")
def q_accent_key(spark: SparkSession, d: str) -> DataFrame:
    """Each whole text without accents and case."""
    return table(spark, d, "documents").select("doc_id", S.plain_name("text").alias("plain"))


@query("""WITH w AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t, len(text) AS n FROM documents)
SELECT kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT n, CASE WHEN contains(t, ' traded ') THEN 'Trades' WHEN contains(t, ' signed ') THEN 'Signings' WHEN contains(t, ' waived ') THEN 'Waived'
  WHEN contains(t, ' released ') THEN 'Released' WHEN contains(t, ' claimed ') THEN 'Claimed' WHEN contains(t, ' activated ') THEN 'Activated' WHEN contains(t, 'injured list') THEN 'Injured list' ELSE 'Other' END AS kind FROM (
  SELECT n, replace(replace(replace(t, ' this ', ' traded '), ' with ', ' signed '), ' from ', ' waived ') AS t FROM w)) GROUP BY kind""")
def q_text_classify(spark: SparkSession, d: str) -> DataFrame:
    """The verb classifier over texts in which three frequent words stand for verbs."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    for word, verb in (("this", "traded"), ("with", "signed"), ("from", "waived")):
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {verb} "))
    return table(spark, d, "documents").select(S.transaction_kind(text).alias("kind"), F.length("text").alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


DAY = "'(?i)\\b(January|February|March|April|May|June|July|August|September|October|November|December)\\s+(\\d{1,2})\\b'"


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, 'on %B %-d, %Y') ELSE '' END AS sub, strftime(o_orderdate, 'ordered %B %d') AS cell FROM orders),
x AS (SELECT o_orderkey, CASE WHEN regexp_matches(sub, {DAY}) THEN sub ELSE cell END AS t FROM o)
SELECT o_orderkey, regexp_extract(t, {DAY}, 1) || ' ' || CAST(CAST(regexp_extract(t, {DAY}, 2) AS INTEGER) AS VARCHAR) AS hint FROM x""")
def q_date_hint(spark: SparkSession, d: str) -> DataFrame:
    sub = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "'on' MMMM d, yyyy")).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", S.date_hint(sub, F.date_format("o_orderdate", "'ordered' MMMM dd")).alias("hint"))


@query("""SELECT doc_id, regexp_matches(text, '(?is)the.{0,700}of.{0,700}and') AS found FROM documents""")
def q_phrase_gap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.phrase_gap(F.col("text"), ["the", "of", "and"]).alias("found"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&ndash;', '–'), '&amp;', '&') AS t FROM s)
SELECT page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS plain FROM u""")
def q_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.strip_html(F.col("html")).alias("plain"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS link FROM pages""")
def q_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(S.links(F.col("html"))).alias("link"))


@query()
def q_html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each page with the heading above them; a parser's work, so no SQL."""
    return textops.blocks_of(table(spark, d, "pages"), "html", ["page_id"])


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, t.fullkey AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' ELSE 'null' END AS kind,
  CAST(t.atom AS VARCHAR) AS value FROM events, json_tree(props) AS t""")
def q_json_walk(spark: SparkSession, d: str) -> DataFrame:
    """Paths and values of the events' properties, at any depth."""
    return variants.walk(table(spark, d, "events"), "props", ["event_id"])


@query("""WITH n AS (SELECT DISTINCT p_type || ' ' || p_name || 'PctOnOff%' AS name FROM part),
x AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM n)
SELECT name, CASE WHEN s = '' THEN 'field' ELSE lower(s) END AS slug FROM x""")
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_type", F.lit(" "), "p_name", F.lit("PctOnOff%"))
    return table(spark, d, "part").select(name.alias("name")).distinct().select("name", S.slug(F.col("name")).alias("slug"))


@query("""WITH b AS (SELECT p_partkey AS other, p_name AS other_name, p_brand, p_size AS other_size FROM part),
c AS (SELECT a.p_partkey, b.other, CAST(levenshtein(p_name, other_name) AS DOUBLE) / greatest(len(p_name), len(other_name)) AS distance, abs(p_size - other_size) AS gap FROM part a JOIN b USING (p_brand) WHERE a.p_partkey <> b.other),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY distance, gap, other) AS INTEGER) AS place FROM c WHERE distance <= 0.6)
SELECT p_partkey, other, distance, CAST(gap AS INTEGER) AS gap, place FROM r WHERE place <= 5""")
def q_topk_match(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other names of the same brand for every part."""
    out = matching.best_matches(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_name", "p_size")
    return out.withColumn("gap", F.col("gap").cast("int"))
