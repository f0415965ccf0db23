"""The corpus pipeline: toxicity, near-duplicate join, decontamination, mixing, token output.

Each stage is a function of (spark, docs, sf_dir) and works on all rows its predecessor kept; the
rows between stages are Parquet in the shared folder.  All stages but the last return the columns
of documents.  SQL cannot express the classifier, so the whole has no SQL; tests compare each
stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.shared import shared_dir, written
from graphloom.llm import decontam, jaccard, mixing, tokens, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels beside the input."""
    return toxicity.rejecting(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there once for each draw, cut where the target ends; draws are shuffled within a task."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans and checksums of all documents, read back from the token files."""
    import public_tokenizers

    return tokens.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    where = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{where}/{k}_{name}")
    return docs
