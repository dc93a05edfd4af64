"""From raw documents to token ids: language, near duplicates, benchmark passages, mixture, ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``.  Between stages the rows are written to the shared folder and read again, so a
lost executor costs part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, neardup, tokens
from tidemark.llm.common import table
from tidemark.llm.queries import language_model, tokenizer_path
from tidemark.session import cut_lineage, ship

LEAST_SCORE = 0.5


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    ship(spark)
    return langid.identified(docs, language_model(docs), LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8."""
    ship(spark)
    return neardup.deduplicated(docs, shingle=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    ship(spark)
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, repeated as often as it reads them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids on disk; one row per document read back."""
    ship(spark)
    return tokens.token_output(docs, tokenizer_path())


STAGES = [
    ("language_id", recognise),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", encode),
]
ORACLE_SQL = None  # a learned model and a tokenizer; tests/llm compares it with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
