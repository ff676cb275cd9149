"""A corpus made ready for training: five stages, each written as Parquet and read again.

Quality rules, near-duplicates, personal data, mixing and packing, in this order. Every
stage takes all that the one before it kept; all but the last return the columns of
``documents``.

Defined results, as the operators define them: a null or empty text fails the quality rules
and goes; texts of any length are read whole; a null ``doc_id`` is judged by its row and
stays a row of its own; repeated rows of one ``doc_id`` and text have one fate; a null
source is a source of its own; further columns are passed on up to the last stage; no
documents give no rows. A Parquet read keeps no order, so packing works out each
document's place in the mixture again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm import minhash, mixing, packing, pii, quality
from evoframe.llm._common import materialize


#: Target weight of each source; without it, those of ``mixing.mixed``.
WEIGHTS: dict[str | None, float] | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; the labels of ``sf_dir`` name the trusted ones."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of smallest id."""
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; ``n_chars`` is that of the new text."""
    changed = pii.replace_pii(docs)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.in_mixed_order(docs, weights=WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there, in the order of the mixture."""
    return packing.mixed_packing_digest(docs, weights=WEIGHTS)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: Hashes, tokenizers and surrogates are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
