"""Training corpus from `documents`: toxic texts go, one of each near-duplicate group stays, repeated
passages are cut, secrets are masked, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet
and read again for the next.  All but the last return the columns of documents.  A text that the
substring stage empties keeps its row.  Null texts pass every stage and become one end id when packed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import jaccard_join, packing, secret_scan, substrings, toxicity
from marketloom.llm.common import materialize, read_table
from marketloom.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labels outside the held-out fold, scores below 0.3."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of texts linked at 0.8 over five-word runs."""
    return jaccard_join.keep_one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words outside windows of 50 that also start in a smaller document."""
    return substrings.cut_texts(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mask."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, byte_bpe(), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A learned grammar, a similarity join and a tokenizer are beyond SQL: the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
