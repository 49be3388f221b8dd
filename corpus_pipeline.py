"""A training-data pipeline over ``documents``: toxic documents go, one document
of each group of near duplicates stays, documents that hold benchmark items go,
secrets are masked, and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns they were given, and null, empty and repeated rows are
treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare, stored
from retrievalkit.llm.decontaminate import decontaminated
from retrievalkit.llm.minhash_dedup import deduplicated
from retrievalkit.llm.packing import pack
from retrievalkit.llm.secret_scan import redact_secrets
from retrievalkit.llm.toxicity import fit, not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted on ``labels`` scores below one half."""
    return not_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group on 5-word shingles
    at 0.8. Unlike rows that share an id both stay; so do rows without an id."""
    return deduplicated(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and ``n_chars`` counted anew."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mask_secrets", mask_secrets), ("packing", packing)]

#: No SQL for the grammar, the components and the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, from ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
