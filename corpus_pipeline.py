"""The corpus pipeline: documents to packed training sequences, each stage written and read again.

Every stage takes rows with null ids, null, empty or very long texts, repeated rows and extra columns,
and tables without rows, as its operator says; all but the last return the columns that they get:

- language ID drops null texts and those without a letter, and those of no likely language; without a
  row that has a language to learn from it drops all;
- line dedup counts rows that repeat doc_id and text as one document; a document that loses all its
  lines goes;
- SimHash near-dedup keeps one row of each group, of equal rows one;
- decontamination judges each row by its own text;
- packing gives pieces with their ids for every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontamination, language_id, line_dedup, packing, simhash
from leafmill.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without a letter, or with no likely language, go."""
    model = language_id.train(language_id.training_rows(docs), language_id.load_pieces(language_id.vocabulary_path()))
    return language_id.keep_identified(docs, model)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats or resembles."""
    return line_dedup.deduplicate_lines(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, packing.byte_bpe_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash_near_dedup", deduplicate_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language ID and packing are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
