"""The training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Quality rules, MinHash near-duplicates, personal data, mixing to target weights, byte-pair encoding. All stages but the
last return the columns of ``documents``; each result is written as Parquet and read again for the next. Rows with NULLs,
empty and very long texts, ties, repeated rows, empty tables and extra columns go through each stage as the operator it
calls says; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fennelmill.llm import bpe, mixing, pii, quality, sketch_dedup
from fennelmill.llm.common import discard, in_file_order, materialise, scratch_of, table
from fennelmill.llm.queries import tokenizer_path

#: No SQL can express the stages that score context, sketch sets or encode pairs; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return quality.clean(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return sketch_dedup.drop_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: each document as often as the weight of its language asks, at least once.

    A stage may add no columns, so the order of the stream is that of the rows: written, files and their rows follow it.
    """
    return mixing.mix(docs, source_column="lang").orderBy("mix_slot", "mix_order").drop(*mixing.ADDED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the written stream, and what they decode to, as digests, with its ``position`` in the stream."""
    placed = in_file_order(docs, "position").select(F.struct("doc_id", "position").alias("id"), "text")
    coded = bpe.encode_decode(placed, tokenizer_path(), id_column="id").select("id.doc_id", "id.position", "ids", "decoded")
    return bpe.digests(coded, "doc_id", "position")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of a folder. What a stage wrote for itself goes as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_of() as kept:
            out = materialise(stage(spark, docs, sf_dir), f"stage{i}")
            kept.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
