"""A training-corpus pipeline over ``documents``: five stages, each an operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

Defined results, stage by stage: a null or blank text has no language and goes first, and
is kept by the near-duplicate and secret stages where it comes to them; a very long text is
read whole by all; of rows that repeat id and text one stays after the near-duplicate stage,
of equal texts the one of the smallest id, null last; ties in the mix go by id; an empty table stays
empty; extra columns are kept by all but the last stage, and those whose names start with two underscores are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard, langid, mixing, packing, secrets
from skein.llm.common import durable, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of no language that the labelled rows teach, go."""
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more stays."""
    return jaccard.keep_one(docs)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return secrets.drop_leaking(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays as often as the mix takes it."""
    return mixing.apply_mix(docs, read(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", drop_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The network and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
