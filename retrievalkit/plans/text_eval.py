"""Text retrieval on the conversation dataset (user turns -> the assistant
answers), with the E2 stand-in encoder: the text path of the evaluation
pipeline (E*, R2, M9) plus mining, reranking and training rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.functions.vectors import dot, norm
from retrievalkit.operators import metrics as M
from retrievalkit.operators import sampling as U
from retrievalkit.operators.embed import hash_embed
from retrievalkit.operators.search import check_scores, knn, retrieve
from retrievalkit.session import ensure_checkpoint_dir, materialised
from retrievalkit.sources import imports as D
from retrievalkit.sources import testdata
from retrievalkit.sources.store import load_tables, save_tables
from retrievalkit.tables import RagTables

RATIO = 0.1
SEED = 42
DIM = 64
QUERY_INSTRUCTION = "query: "
K = 100
KS = (1, 3, 5, 10)


def build_dataset(spark: SparkSession, sf: str, splits: bool = True) -> RagTables:
    """Import the conversation dataset (D5) and split it."""
    t = D.import_triples(spark, testdata.conversation_pairs(spark, sf).select(
        "query", "positive", "negative", "ord"))
    if not splits:
        return t
    return t.with_(splits=U.split_train_val(t.queries, RATIO, SEED))


def dataset(spark: SparkSession, sf: str, splits: bool = True) -> RagTables:
    """The conversation dataset as the pipeline steps read it: imported from the
    given tables, split unless ``splits`` is false, saved with D3 in the shared
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/conversations-{uuid.uuid4().hex}"
    save_tables(build_dataset(spark, sf, splits), path)
    return load_tables(spark, path)


def query_vectors(tables: RagTables, split: str | None = None, dim: int = DIM) -> DataFrame:
    qs = U.select_split(tables, split)
    return hash_embed(qs, dim, id_col="query_id", instruction=QUERY_INSTRUCTION)


def corpus_vectors(tables: RagTables, dim: int = DIM) -> DataFrame:
    return hash_embed(tables.corpus, dim, id_col="doc_id")


def distance_run(tables: RagTables, split: str | None = None, k: int = K) -> DataFrame:
    """Raw squared-L2 top-k (scores are distances)."""
    r = knn(query_vectors(tables, split), corpus_vectors(tables), k, "sq_l2")
    return r.select(F.lit("hash64").alias("run_id"), "query_id", "doc_id", "score", "rank")


def run(tables: RagTables, split: str | None = None, k: int = K) -> DataFrame:
    """R2: similarity 1 / (1 + distance)."""
    return retrieve(query_vectors(tables, split), corpus_vectors(tables), k,
                    run_id="hash64", metric="sq_l2")


def run_benchmark(tables: RagTables, split: str | None = "val", ks=KS, k: int = K,
                  per_query: bool = False) -> DataFrame:
    """M9: E6 -> R2 -> R3 -> M1 -> M8 (M7 when ``per_query``). The run is
    written once; queries without any score in [0, 1] leave it."""
    r = check_scores(materialised(run(tables, split, k), "run"), drop=True)
    qrels = M.build_qrels(tables.qrels)
    pq = M.per_query_metrics(M.judge_run(r, qrels), M.num_relevant(qrels), ks)
    return pq if per_query else M.compute_metrics(pq, ks)


def pair_scores(pairs: DataFrame, tables: RagTables, dim: int = 128) -> DataFrame:
    """A second scorer for R5: cosine of 128-bucket hash vectors of each
    candidate pair (computed only for the candidate pairs, by join)."""
    # only the texts that occur in candidate pairs are embedded
    cand = tables.with_(
        queries=tables.queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi"),
        corpus=tables.corpus.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"))
    # a vector's length is summed once, not for every pair it is in; written, for a planner may sum it anew
    def with_norm(vecs: DataFrame, key: str, name: str) -> DataFrame:
        return materialised(vecs.select(F.col("id").alias(key), F.col("vec").alias(name),
                                        norm("vec").alias(f"{name}_norm")), f"pair-{name}")

    qv, cv = with_norm(query_vectors(cand, None, dim), "query_id", "qv"), with_norm(corpus_vectors(cand, dim), "doc_id", "cv")
    both = pairs.select("query_id", "doc_id").join(qv.hint("merge"), "query_id").join(cv.hint("merge"), "doc_id")
    den = F.col("qv_norm") * F.col("cv_norm")
    return both.select("query_id", "doc_id", F.round(F.when(den > 0, dot("qv", "cv") / den).otherwise(0.0), 6).alias("score"))
