"""Flagship: exact leave-one-out search over the whole ``embeddings`` table,
scored with nDCG / MAP / recall / precision / MRR at 1, 3, 5, 10 where a
document is relevant when it carries the query's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.operators import metrics as M
from retrievalkit.operators.search import knn
from retrievalkit.sources import testdata

K = 10
KS = (1, 3, 5, 10)


def label_run(spark: SparkSession, sf_dir: str, metric: str = "cosine", k: int = K,
              **knn_args) -> DataFrame:
    v = testdata.vectors(spark, sf_dir)
    run = knn(v, v, k, metric, exclude_self=True, **knn_args)
    return run.select(F.lit(metric).alias("run_id"), "query_id", "doc_id", "score", "rank")


def label_judged(spark: SparkSession, sf_dir: str, run: DataFrame):
    v = testdata.vectors(spark, sf_dir)
    return M.judge_by_label(run, v.select(F.col("id").alias("query_id"), "label"),
                            v.select(F.col("id").alias("doc_id"), "label"), exclude_self=True)


def label_per_query(spark: SparkSession, sf_dir: str, metric: str = "cosine",
                    ks=KS, **knn_args) -> DataFrame:
    run = label_run(spark, sf_dir, metric, max(max(ks), K), **knn_args)
    judged, nr = label_judged(spark, sf_dir, run)
    return M.per_query_metrics(judged, nr, ks)


def label_metrics(spark: SparkSession, sf_dir: str, metric: str = "cosine", ks=KS,
                  **knn_args) -> DataFrame:
    return M.compute_metrics(label_per_query(spark, sf_dir, metric, ks, **knn_args), ks)
