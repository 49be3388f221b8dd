"""
encoder: each is a composition of the operators, one Spark plan per step.

* ``evaluate_model``  - entry A: embed corpus and queries, exact search, metrics (M9).
* ``mine_and_replace`` / ``make_training_rows`` - entry B: hard negatives, then
  contrastive rows.
* ``synthesize`` - entry B: prompts out, parsed responses back into the dataset.
* ``tune_and_evaluate`` - entry C: NUDGE-tuned corpus vectors, then metrics.

``encoder_factory`` builds a ``list[str] -> ndarray`` encoder inside each task
(E1). With ``store_path`` the vectors go through the incremental store (E4)
keyed by ``model_name``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.operators import embed as E
from retrievalkit.operators import metrics as M
from retrievalkit.operators import nudge as N
from retrievalkit.operators import sampling as U
from retrievalkit.operators import search as R
from retrievalkit.operators.vector_files import write_vectors
from retrievalkit.operators import synth as Q
from retrievalkit.operators import training as T
from retrievalkit.session import materialised
from retrievalkit.tables import RagTables

KS = (1, 3, 5, 10)


def _embedder(encoder_factory, role: str, instruction: str | None, store_path: str | None,
              model_name: str | None, batch_size: int, normalize: bool):
    def plain(df: DataFrame) -> DataFrame:
        return E.embed(df, encoder_factory, role="none", batch_size=batch_size,
                       normalize=normalize)

    def run(df: DataFrame) -> DataFrame:
        """Vectors written once: every text meets the encoder a single time."""
        if store_path:
            out = E.embed_incremental(df, store_path, model_name or "model", embed_fn=plain,
                                      role=role, instruction=instruction, normalize=normalize)
        else:
            out = plain(df.withColumn("text", E.with_prefix("text", instruction)))
        return materialised(out, f"{role}-vectors")
    return run


def embed_corpus(tables: RagTables, encoder_factory, *, passage_instruction=None,
                 store_path=None, model_name=None, batch_size=256, corpus_batch_size=0,
                 normalize=True) -> DataFrame:
    """``(id, vec)`` of the whole corpus (``corpus_batch_size`` 0: ``batch_size``)."""
    fn = _embedder(encoder_factory, "corpus", passage_instruction, store_path, model_name,
                   corpus_batch_size or batch_size, normalize)
    return fn(tables.corpus.select(F.col("doc_id").alias("id"), "text"))


def embed_queries(tables: RagTables, encoder_factory, split: str | None = None, *,
                  query_instruction=None, store_path=None, model_name=None, batch_size=256,
                  normalize=True) -> DataFrame:
    fn = _embedder(encoder_factory, "query", query_instruction, store_path, model_name,
                   batch_size, normalize)
    return fn(U.select_split(tables, split).select(F.col("query_id").alias("id"), "text"))


def evaluate_model(tables: RagTables, encoder_factory: Callable, split: str | None = "val", *,
                   k: int = 100, ks=KS, query_instruction: str | None = None,
                   passage_instruction: str | None = None, store_path: str | None = None,
                   model_name: str | None = None, run_id: str = "run",
                   judged_pool_only: bool = False, per_query: bool = False,
                   batch_size: int = 256, corpus_batch_size: int = 0,
                   normalize: bool = True) -> DataFrame:
    """Entry A (M9): metrics of exact search with the given encoder.

    ``judged_pool_only`` restricts the corpus to documents judged for the
    evaluated queries (U7)."""
    corpus = tables
    if judged_pool_only:
        corpus = tables.with_(corpus=U.judged_pool(tables, split))
    cv = embed_corpus(corpus, encoder_factory, passage_instruction=passage_instruction,
                      store_path=store_path, model_name=model_name, batch_size=batch_size,
                      corpus_batch_size=corpus_batch_size, normalize=normalize)
    qv = embed_queries(tables, encoder_factory, split, query_instruction=query_instruction,
                       store_path=store_path, model_name=model_name, batch_size=batch_size,
                       normalize=normalize)
    run = materialised(R.retrieve(qv, cv, k, run_id=run_id), "run")
    run = R.check_scores(run, drop=True)   # R3: queries with no score in [0, 1] leave the run
    qrels = M.build_qrels(tables.qrels)
    pq = M.per_query_metrics(M.judge_run(run, qrels), M.num_relevant(qrels), ks)
    return pq if per_query else M.compute_metrics(pq, ks)


def mine_and_replace(tables: RagTables, encoder_factory: Callable, split: str = "train", *,
                     k: int = 100, start: int = 50, n: int = 15, seed: int = 42,
                     query_instruction: str | None = None, exclude_positives: bool = False,
                     on_short: str = "error", store_path: str | None = None,
                     model_name: str | None = None) -> RagTables:
    """Entry B, mining: search top-k for the split's queries, sample ``n``
    negatives from ranks ``start+1..k``, replace those queries' negatives."""
    cv = embed_corpus(tables, encoder_factory, store_path=store_path, model_name=model_name)
    qv = embed_queries(tables, encoder_factory, split, query_instruction=query_instruction,
                       store_path=store_path, model_name=model_name)
    run = materialised(R.retrieve(qv, cv, k), "run")
    mined = R.mine_hard_negatives(run, tables.qrels, start=start, stop=k, n=n, seed=seed,
                                  exclude_positives=exclude_positives, on_short=on_short)
    return tables.with_(qrels=R.replace_negatives(tables.qrels, mined))


def make_training_rows(tables: RagTables, split: str | None = "train", negative_num: int = 0,
                       query_instruction: str | None = None,
                       passage_instruction: str | None = None, seed: int = 42):
    """Entry B, rows: ``(rows, columns)`` plus the skipped-query report."""
    rows, cols = T.training_rows(tables, split, negative_num, query_instruction,
                                 passage_instruction, seed)
    return rows, cols, T.skipped_queries(tables, split, negative_num)


def synthesis_prompts(tables: RagTables, n_docs: int, *, seed: int = 42,
                      template: str = Q.DEFAULT_QA_TEMPLATE,
                      n_questions: int = Q.DEFAULT_N_QUESTIONS,
                      answered: DataFrame | None = None) -> DataFrame:
    """Entry B, synthesis (out): prompts for ``n_docs`` sampled documents that
    still need a response."""
    docs = U.sample_docs(tables.corpus.select("doc_id", "text"), n_docs, seed)
    return Q.distinct_prompts(Q.render_prompts(docs, template, n_questions), answered)


def synthesize(tables: RagTables, responses: DataFrame, split: str = "train") -> RagTables:
    """Entry B, synthesis (back): parse ``(corpus_id, response)`` and add the
    questions as training queries of their source documents."""
    return Q.append_synthetic(tables, Q.explode_qa(Q.parse_qa(responses)), split)


def tune_and_evaluate(tables: RagTables, encoder_factory: Callable, kind: str = "nudge-n", *,
                      train_split: str = "train", val_split: str = "val",
                      test_split: str | None = None, grid=N.DEFAULT_GRID, k: int = 10,
                      ks=KS, query_instruction: str | None = None, store_path: str | None = None,
                      model_name: str | None = None, metric: str = "sq_l2"):
    """Entry C: NUDGE-tuned corpus (gamma chosen on ``val_split``) and the
    metrics of a search with it on ``test_split`` (default: the validation
    split, as the reference evaluates). Returns ``(metrics, tuned vectors, gamma)``.

    The metrics come from the distance search of entry A (``1 / (1 + d)``) for
    both kinds; ``metric="dot"`` ranks NUDGE-M, whose vectors are not of unit
    length, as its gamma was chosen."""
    cv = embed_corpus(tables, encoder_factory, store_path=store_path, model_name=model_name)
    qv = embed_queries(tables, encoder_factory, None, query_instruction=query_instruction,
                       store_path=store_path, model_name=model_name)
    tuned, gamma, _ = N.nudge_finetune(cv, qv, tables.qrels, tables.splits, kind,
                                       train_split, val_split, grid)
    tuned = materialised(tuned, "tuned")
    ev = test_split or val_split
    eq = qv.join(tables.splits.where(F.col("split") == ev).select(F.col("query_id").alias("id")),
                 "id", "left_semi")
    run = R.retrieve(eq, tuned, k, run_id=kind, metric=metric)
    qrels = M.build_qrels(tables.qrels)
    pq = M.per_query_metrics(M.judge_run(run, qrels), M.num_relevant(qrels), ks)
    return M.compute_metrics(pq, ks), tuned, gamma


def compare_tuned(tables: RagTables, query_vecs: DataFrame, doc_vecs: DataFrame, *, train_split: str = "train",
                  dev_split: str = "dev", test_split: str = "test", grid=N.DEFAULT_GRID, k: int = 10,
                  ks=(10,)) -> DataFrame:
    """Entry C, side by side: the corpus as it is and tuned by NUDGE-M and NUDGE-N
    (targets from the train split, gamma chosen on the dev split; ``grid=None``
    takes the best of all values), searched by the test split's queries, each
    run next to the untuned one: ``(run_id, metric, k, value, base_value,
    delta)``. Both vector tables are read several times: pass written ones."""
    asked = tables.splits.where(F.col("split") == test_split).select(F.col("query_id").alias("id"))
    queries = write_vectors(query_vecs.join(asked, "id", "left_semi"))
    runs = [("none", "cosine", doc_vecs)]
    for kind in N.KINDS:
        tuned, _, _ = N.nudge_finetune(doc_vecs, query_vecs, tables.qrels, tables.splits, kind, train_split, dev_split, grid)
        runs.append((kind, N.search_metric(kind), tuned))
    run = None
    for name, metric, docs in runs:
        found = R.search_blocks(queries, write_vectors(docs), k, metric).select(
            F.lit(name).alias("run_id"), "query_id", "doc_id", "score", "rank")
        run = found if run is None else run.unionByName(found)
    qrels = M.build_qrels(tables.qrels)
    pq = M.per_query_metrics(M.judge_run(materialised(run, "runs"), qrels), M.num_relevant(qrels), ks)
    return M.compare_runs(M.compute_metrics(pq, ks), "none", ks)
