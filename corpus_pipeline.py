"""A training corpus from raw documents: good, distinct, without personal data, mixed to weights, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``; further columns, of any name, are carried with their values. An empty table gives
an empty one at every stage. Null ids are ids like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import staged, table
from noteloom.llm.minhash import keep_one_of_each
from noteloom.llm.mixing import take_mix
from noteloom.llm.pieces import encode_documents
from noteloom.llm.pii import redact
from noteloom.llm.quality_rules import keep_good
from noteloom.llm.queries import good_rows, piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the labelled good ones.

    Null, empty and white texts have no words and go. Repeated rows are judged alike and all stay or go.
    """
    return keep_good(docs, good_rows(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, from a similarity of 0.8.

    24 bands of 5 minima miss a pair at exactly 0.8 with probability 0.00007. Null and empty texts are near to none; rows
    that repeat id and text leave one.
    """
    return keep_one_of_each(docs, percent=80, bands=24, rows=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the number of characters follows the text.

    A null text stays null, and its number of characters is null; repeated rows are all redacted.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that every source gets its share of words.

    Null and empty texts have no words and are never taken; repeated rows are rows of their own; a null source is one.
    """
    return take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the pieces of every text, a row for each row; a null or empty text has none."""
    return encode_documents(docs, piece_model()).select("doc_id", "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: The stages hash with functions that DuckDB lacks and iterate; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
