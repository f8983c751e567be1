"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Cases, for every stage: null text counts as empty and stays null where the row stays; empty and very long texts are read whole;
a null doc_id is kept, and never names a class of near-duplicates; of rows that repeat a kept doc_id and text one stays after
the near-duplicate stage; ties at a threshold are accepted as scores and linked as copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, near_dups, packing, private_data, quality
from tracewell.llm.common import drop_materialized, materialize, table
from tracewell.llm.tokens import default_path


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dups.keep(docs, threshold=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return private_data.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", accept_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("personal data", redact_private_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
            if written is not None:
                drop_materialized(spark, written)
            written = docs
    return docs


QUERIES = {"pipeline": run}
#: Hashing, sampling and tokenisation have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None
