"""Five corpus stages in a row: rules, near-duplicate removal, redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last
one the token ids beside them.  ``run`` writes every stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import common, mixing, ngram_join, piece_lattice, quality_rules, queries, secrets

#: How often a document's share in each domain is to count after mixing: clean text gains, the rest shrinks.
#: A document as likely clean as poor counts once, so that no clean one goes for a doubtful posterior.
FACTORS = {"clean": 1.25, "poor": 0.75, "toxic": 0.25}


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become their kind in brackets; n_chars follows."""
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go by their rate."""
    return mixing.resample(docs, queries.domain_labels(spark, sf_dir), FACTORS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, in a column beside the others."""
    return piece_lattice.encode(docs, queries.tokenizer_file(queries.PIECE_MODEL))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_domains),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The learned list, the classifier's rates and the piece lattice have no SQL form; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        common.release(before)
    return docs
