"""JSON at any depth, walked level by level with variants: no row passes through Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.scratch import kept

#: Kinds by the type of a variant (fixed values).
KINDS = (("OBJECT", "object"), ("ARRAY", "array"), ("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("STRING", "str"), ("BOOLEAN", "bool"))


def _kind(value: Column) -> Column:
    kind, name = F.lit("null"), F.schema_of_variant(value)
    for prefix, shown in reversed(KINDS):
        kind = F.when(name.startswith(prefix), shown).otherwise(kind)
    return kind


def _text(value: Column, kind: Column) -> Column:
    """A scalar as JSON text, a fraction as a double's; containers and null have none."""
    fraction = F.try_variant_get(value, "$", "double").cast("string")
    return F.when(kind == "float", fraction).when(~kind.isin("object", "array", "null"), F.to_json(value))


def walk(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, path, kind, value) of every object, array and scalar of a JSON text: `$`, `$.name`, `$.list[0]`.

    Each round explodes the containers of one level; the rounds end when none is left, so
    there are as many as the deepest text has levels (the parser takes 1,000 at most).  A
    null or invalid text, or one that repeats a name, gives no rows.  Whole numbers are
    `int` up to 64 bits and `float` beyond.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    level = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v")).where("v is not null")
    made = None
    while True:
        level = level.withColumn("kind", _kind(F.col("v")))
        shown = level.select(*names, "path", "kind", _text(F.col("v"), F.col("kind")).alias("value"))
        made = shown if made is None else made.unionByName(shown)
        inner = level.where(F.col("kind").isin("object", "array")).alias("outer")
        parts = rows.sparkSession.tvf.variant_explode(F.col("outer.v").outer()).alias("part")
        step = F.when(F.col("outer.kind") == "object", F.concat(F.lit("."), F.col("part.key"))).otherwise(F.concat(F.lit("["), F.col("part.pos").cast("string"), F.lit("]")))
        level = kept(inner.lateralJoin(parts).select(*[F.col(f"outer.{n}") for n in names], F.concat("outer.path", step).alias("path"), F.col("part.value").alias("v")))
        if level.isEmpty():
            return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "path", "kind", "value")
