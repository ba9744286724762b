"""A corpus pipeline of the training-data operators.

Documents of low quality go, then copies, then near copies; what stays is mixed to the sources'
target weights and encoded.

Every stage takes rows with nulls in any column, empty and very long texts, ties, repeated rows and
extra columns of any name, and an empty table; what each then gives is the operator's to say. A null
text is an empty one throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornpress.llm import bpe, exact_dedup, mixing, quality, simhash
from hornpress.llm.common import spill_table, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model predicts good, by their text alone. It is fitted on labelled rows of docs that aren't held out."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest, then the smallest id, null ids last."""
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked by any chain of them, the row of the smallest id, null ids last."""
    return simhash.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is a source."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row for each row of docs."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing to target weights", mixed),
    ("BPE encoding", encoded),
]

#: SQL can't express the first stage, nor the third and the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from documents. Each stage's output is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill_table(docs)
    return docs
