"""The training-data pipeline: language ID, exact dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and all but the last return the
columns of documents, whatever others docs has and whatever they are called. run() writes each stage as Parquet in the
shared folder and reads it back for the next. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tideglass.llm.queries import tokenizer
from tideglass.llm.store import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `und` (null and empty texts, texts without letters) and very uncertain ones
    go. Repeated rows fare alike; null doc_ids and sources matter nothing; a null lang teaches nothing."""
    return language_id.reject(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null is the smallest, of rows that tie on it one stays. Null text
    is empty text."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id; null is the largest, of rows that tie on it one
    stays. Rows without words (null text too) are in no group and stay."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to target weights, in a global random order. Null sources are one source; rows of one doc_id
    are repeated equally often; a source without any text has rate 1."""
    return mixing.replicate(docs, added=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens: every row is a document, repeated ones too; null text is empty."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, fingerprints' groups and token ids are not expressible in SQL; tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
