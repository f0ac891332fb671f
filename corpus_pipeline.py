"""A training corpus from raw documents: quality, near-duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns they came with; the last
one returns piece ids instead of texts. ``run`` writes what each stage returns to the shared checkpoint folder
and reads it back, so a lost executor costs at most the stage at work. Stages handle nulls in any
column, empty tables and further columns; their operators' docstrings say how.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import credentials, mixing, pieces, quality_rules, simhash
from paperloom.session import write_through


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their language and source."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component (three-word shingles, two bits): the one with the smallest id."""
    return simhash.keep_first(docs, shingle=3, budget=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and ``n_chars`` set anew."""
    return credentials.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet the square root of their shares, in random order."""
    return mixing.mix(docs, marks=False)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the piece ids of every document, and whether decoding them gives its text back."""
    model = pieces.read_model(pieces.default_model())
    rows = pieces.encode(docs, model, keep=["doc_id", "lang", "source", "n_chars"], check="round_trip")
    return rows.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: SimHash components and merged pieces can't be expressed in SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
