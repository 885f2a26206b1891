"""From raw documents to token ids: five stages, each one operator of the llm subpackage.

All stages but the last return the columns of documents. Language ID drops documents whose
language cannot be told; line dedup shortens texts and keeps every document; SimHash near-dedup
keeps the smallest doc_id of each group; decontamination drops documents that hold a benchmark passage;
SentencePiece encodes what is left and checks that decoding restores it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.llm import decontamination, language_id, line_dedup, sentencepiece_codec, simhash
from quillworks.llm.common import staged
from quillworks.llm.queries import PIECE_MODEL, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.clean(docs, shingle=3, max_bits=3)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.load(PIECE_MODEL))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding and decoding", encode),
]

#: Language ID, SimHash and SentencePiece have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.lower().replace(' ', '-')}")
    return last(spark, docs, sf_dir)
