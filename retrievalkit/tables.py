"""Schemas of the long tables that represent one retrieval dataset.

A dataset is never one map per field (a 370k-document corpus would be one row
in one task); it is five normalised tables keyed by string ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("ord", T.LongType(), True),
])
CORPUS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("ord", T.LongType(), True),
])
# relevance 1 = relevant_docs, 0 = negative_docs
QRELS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("relevance", T.IntegerType(), False),
])
ANSWERS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("answer", T.StringType(), True),
])
SPLITS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("split", T.StringType(), False),
    T.StructField("ord", T.LongType(), True),
])
VECTORS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType(), False), True),
])
RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("query_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("rank", T.IntegerType(), True),
])

TABLE_SCHEMAS = {
    "queries": QUERIES,
    "corpus": CORPUS,
    "qrels": QRELS,
    "answers": ANSWERS,
    "splits": SPLITS,
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class RagTables:
    """One retrieval dataset as five DataFrames."""

    queries: DataFrame
    corpus: DataFrame
    qrels: DataFrame
    answers: DataFrame
    splits: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, **tables: DataFrame) -> "RagTables":
        """Missing tables become empty ones with the fixed schema."""
        unknown = set(tables) - set(TABLE_SCHEMAS)
        if unknown:
            raise TypeError(f"unknown dataset tables: {sorted(unknown)}")
        full = {}
        for name, schema in TABLE_SCHEMAS.items():
            df = tables.get(name)
            full[name] = empty(spark, schema) if df is None else df.select(*schema.fieldNames())
        return cls(**full)

    def with_(self, **tables: DataFrame) -> "RagTables":
        return replace(self, **tables)

    def positives(self) -> DataFrame:
        return self.qrels.filter("relevance = 1").select("query_id", "doc_id")

    def negatives(self) -> DataFrame:
        return self.qrels.filter("relevance = 0").select("query_id", "doc_id")

    def items(self):
        return [(n, getattr(self, n)) for n in TABLE_SCHEMAS]
