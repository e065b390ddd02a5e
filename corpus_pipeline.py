"""A corpus pipeline: each stage reads what the one before it wrote, and works on all of it.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. ``run`` applies them to the documents table, each result written to the shared folder and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import exact_dedup, language, near, packing, pii
from tracelake.llm.common import bound_batches, settled, table, tables_made


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter) go."""
    bound_batches(spark)
    return language.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the one of the smallest id."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike by 0.8 or more, the document of the smallest id stays."""
    bound_batches(spark)
    return near.kept_rows(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in the text give way to the name of their kind; n_chars follows the text."""
    bound_batches(spark)
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    bound_batches(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Cross-parsing, XXH64 fingerprints and tokenizer ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = tables_made()
    for name, stage in STAGES:
        # What the stage made on the way goes once its result is written, and so does the result of the stage before.
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}", before)
    return docs
