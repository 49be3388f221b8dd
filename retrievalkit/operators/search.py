"""Retrieval: exact top-k search (R1), scored runs (R2), run checks (R3),
hard-negative mining (R4) and reranking from pair-score tables (R5, R6).

R1 writes both sides as block files in the shared folder (``vector_files``), and
its tasks are pairs of a group of queries and a strip of document blocks. A task
keeps the k best per query and skips blocks that cannot change them, so what is
shuffled is at most ``k x |Q| x strips`` rows; no vector passes the driver, and
the plan is the same for any number of blocks.

Vectors that are null, hold a null or non-finite component, or differ in length
from the queries (their most frequent length) take no part: such a query has no
rows and such a document is never returned, and neither changes any other row.

The result is ``row_number() <= k`` over the per-task winners, which Catalyst
plans as a partial ``WindowGroupLimit`` before the exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.functions.keys import sample_key
from retrievalkit.operators import _kernel
from retrievalkit.operators.vector_files import BLOCK_ROWS, BlockFile, VectorBlocks, pair_tasks, write_vectors

_FOUND = "query_id string, doc_id string, score double"
_SCANNED = "pairs long, scored long, blocks long, read long"

GROUP_BYTES = 32 << 20             # float64 bytes of one group of queries
MAX_STATE_ROWS = 500_000           # per task: at most (queries x k) candidate rows kept
_WINDOW = 64                       # block files a task has open at a time
_ROWS_OUT = 50_000                 # rows of a batch that leaves a task


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", *,
        q_id: str = "id", q_vec: str = "vec", c_id: str = "id", c_vec: str = "vec",
        exclude_self: bool = False, group_bytes: int = GROUP_BYTES, clusters: int = 0) -> DataFrame:
    """Exact top-k of every query vector over every corpus vector.

    Output ``(query_id, doc_id, score, rank)``; ``score`` is cosine, dot or
    squared L2 rounded to 6 decimals; rank 1 is the best (highest similarity,
    lowest distance), ties by ``doc_id`` ascending. Fewer than k corpus
    vectors give fewer rows. ``exclude_self`` drops pairs whose ids are equal
    (leave-one-out search of a collection against itself). Zero vectors have
    no cosine and are never returned for that metric. ``clusters`` puts both
    sides in order by that many k-means centres first (worth it from some
    hundred blocks up); the rows are the same.
    """
    qb = write_vectors(queries, q_id, q_vec, clusters=clusters)
    same = queries is corpus and (q_id, q_vec) == (c_id, c_vec)
    cb = qb if same else write_vectors(corpus, c_id, c_vec, clusters=clusters)
    return search_blocks(qb, cb, k, metric, exclude_self=exclude_self, group_bytes=group_bytes)


def _rank(cands: DataFrame, k: int, metric: str) -> DataFrame:
    order = F.col("score").desc() if metric != "sq_l2" else F.col("score").asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("doc_id").asc())
    # a planner takes the found rows for as few as the tasks, and would collect them to broadcast them
    return (cands.withColumn("score", F.round("score", _kernel.DIGITS))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).hint("merge"))


def _group_rows(dim: int, k: int, group_bytes: int) -> int:
    return max(1, min(group_bytes // (8 * max(dim, 1)), MAX_STATE_ROWS // k))


def _searched(k: int, metric: str, exclude_self: bool, item: str, report: bool):
    """A task's work: its groups of queries against the blocks of its strip, the
    nearest of each window of blocks first."""
    def work(groups: list[tuple[np.ndarray, np.ndarray]], blocks: Iterator[BlockFile]) -> Iterator[pa.RecordBatch]:
        searchers = [_kernel.BlockSearcher(ids, Q, k, metric, exclude_self) for ids, Q in groups]
        pairs = scored = seen = read = 0

        def scan(window: list[BlockFile]) -> None:
            nonlocal pairs, scored, read
            balls = [b.ball() for b in window]
            tops = [[s.best_in(ball) for ball in balls] for s in searchers]
            held: list = []                      # small blocks that all queries read are scored as one

            def score() -> None:
                if held:
                    block = _kernel.Block(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held]), metric)
                    for s in searchers:
                        s.add_block(block)
                    held.clear()

            best = [max(t[i].max(initial=-np.inf) for t in tops) for i in range(len(window))]
            for i in sorted(range(len(window)), key=lambda i: -best[i]):
                some = [s.open_for(t[i]) for s, t in zip(searchers, tops)]
                pairs += sum(len(s.q_ids) for s in searchers) * window[i].rows
                read_now = sum(len(x) > 0 for x in some)
                scored += sum(map(len, some)) * window[i].rows
                read += read_now
                if not read_now:
                    continue
                if all(len(x) == len(s.q_ids) for x, s in zip(some, searchers)):
                    held.append(window[i].vectors(item))
                    if not all(s.full for s in searchers) or sum(len(d) for d, _ in held) >= BLOCK_ROWS:
                        score()
                    continue
                block = _kernel.Block(*window[i].vectors(item), metric)
                for x, s in zip(some, searchers):
                    s.add_block(block, None if len(x) == len(s.q_ids) else x)
            score()

        window: list[BlockFile] = []
        for block in blocks:
            seen += len(groups)
            window.append(block)
            if len(window) == _WINDOW:
                scan(window)
                window = []
        scan(window)
        if report:
            yield pa.RecordBatch.from_pydict({"pairs": [pairs], "scored": [scored], "blocks": [seen], "read": [read]})
            return
        for searcher in searchers:
            out = searcher.result()
            for lo in range(0, len(out), _ROWS_OUT):
                yield pa.RecordBatch.from_pandas(out[lo:lo + _ROWS_OUT], schema=pa.schema([
                    ("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())]),
                    preserve_index=False)

    return work


def _checked(k: int, metric: str) -> None:
    if metric not in _kernel.METRICS:
        raise ValueError(f"metric must be one of {_kernel.METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")


def search_blocks(queries: VectorBlocks, corpus: VectorBlocks, k: int, metric: str = "cosine", *,
                  exclude_self: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """R1 between vectors already written as blocks; same output as ``knn``."""
    _checked(k, metric)
    dim = queries.dim
    found = pair_tasks(queries, dim, _group_rows(dim, k, group_bytes), corpus, dim, _FOUND,
                       _searched(k, metric, exclude_self, corpus.item, False), bundle_rows=_group_rows(dim, k, GROUP_BYTES))
    return _rank(found, k, metric)


def scan_report(queries: VectorBlocks, corpus: VectorBlocks, k: int, metric: str = "cosine", *,
                exclude_self: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """What a search of these blocks looks at: ``(pairs, scored, blocks, read)``,
    the pairs of vectors there are and those that were scored, the (group of
    queries, block) pairs and the blocks that were read. One row."""
    _checked(k, metric)
    dim = queries.dim
    tasks = pair_tasks(queries, dim, _group_rows(dim, k, group_bytes), corpus, dim, _SCANNED,
                       _searched(k, metric, exclude_self, corpus.item, True), bundle_rows=_group_rows(dim, k, GROUP_BYTES))
    return tasks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "scored", "blocks", "read")])


def similarity_from_distance(run: DataFrame, col: str = "score") -> DataFrame:
    """R2 score: ``1 / (1 + d)`` of a squared-L2 distance, in (0, 1]."""
    return run.withColumn(col, F.lit(1.0) / (F.lit(1.0) + F.col(col)))


def retrieve(query_vecs: DataFrame, corpus_vecs: DataFrame, k: int = 100, *,
             run_id: str = "run", metric: str = "sq_l2", **knn_args) -> DataFrame:
    """R2: search, then a run table ``(run_id, query_id, doc_id, score, rank)``.

    With the default squared-L2 metric the score is ``1 / (1 + distance)``, as
    a vector store that returns distances is read; rank order is unchanged.
    """
    run = knn(query_vecs, corpus_vecs, k, metric, **knn_args)
    if metric == "sq_l2":
        run = similarity_from_distance(run)
    return run.select(F.lit(run_id).alias("run_id"), "query_id", "doc_id", "score", "rank")


def check_scores(run: DataFrame, queries: DataFrame | None = None, *,
                 drop: bool = False) -> DataFrame:
    """A query passes if **any** of its scores lies in [0, 1].

    Returns the report ``(query_id, problem)`` with problems ``score_range``
    and (when the evaluated ``queries`` are given) ``no_result``; with
    ``drop=True`` returns the run without the failing queries instead.
    """
    per_q = (run.groupBy("query_id")
             .agg(F.bool_or(F.col("score").between(0.0, 1.0)).alias("ok")))
    bad = per_q.where(~F.col("ok")).select("query_id", F.lit("score_range").alias("problem"))
    if queries is not None:
        missing = (queries.select("query_id").distinct()
                   .join(run.select("query_id").distinct(), "query_id", "left_anti")
                   .select("query_id", F.lit("no_result").alias("problem")))
        bad = bad.unionByName(missing)
    if drop:
        return run.join(bad.select("query_id"), "query_id", "left_anti")
    return bad


def mine_hard_negatives(run: DataFrame, qrels: DataFrame, *, start: int = 50, stop: int = 100,
                        n: int = 15, seed: int = 42, exclude_positives: bool = False,
                        on_short: str = "error") -> DataFrame:
    """``n`` negatives per query sampled from ranks ``start+1 .. stop`` of
    its run (0-based slice ``[start:stop]``).

    Queries without a relevant document are skipped. Returns new qrels rows
    ``(query_id, doc_id, relevance=0)`` that *replace* the negatives of the
    mined queries (see ``replace_negatives``). ``on_short='error'`` raises
    (inside the job) when a query has fewer than ``n`` candidates;
    ``'take_all'`` keeps them all.
    """
    pos = qrels.where("relevance = 1").select("query_id", "doc_id")
    window = (run.where((F.col("rank") > start) & (F.col("rank") <= stop))
              .join(pos.select("query_id").distinct(), "query_id", "left_semi"))
    if exclude_positives:
        window = window.join(pos, ["query_id", "doc_id"], "left_anti")
    key = sample_key(seed, "neg", "query_id", "doc_id")
    w = Window.partitionBy("query_id").orderBy(key, F.col("doc_id"))
    cnt = Window.partitionBy("query_id")
    picked = (window.select("query_id", "doc_id")
              .withColumn("n_cand", F.count(F.lit(1)).over(cnt))
              .withColumn("slot", F.row_number().over(w))
              .where(F.col("slot") <= n))
    if on_short == "error":
        # in a filter (not a pruned column) so it is always evaluated
        msg = F.concat(F.lit("fewer than n hard-negative candidates for query "), F.col("query_id"))
        picked = picked.where(F.when(F.col("n_cand") >= n, F.lit(True)).otherwise(F.raise_error(msg)))
        mined_q = run.select("query_id").distinct().join(
            pos.select("query_id").distinct(), "query_id", "left_semi")
        empty = mined_q.join(window.select("query_id").distinct(), "query_id", "left_anti")
        picked = picked.select("query_id", "doc_id").unionByName(
            empty.select("query_id", F.raise_error(msg).cast("string").alias("doc_id")))
    elif on_short != "take_all":
        raise ValueError("on_short must be 'error' or 'take_all'")
    return picked.select("query_id", "doc_id", F.lit(0).cast("int").alias("relevance"))


def replace_negatives(qrels: DataFrame, mined: DataFrame) -> DataFrame:
    """Mined queries lose their old negatives; everything else is kept."""
    mined_q = mined.select("query_id").distinct()
    kept_neg = (qrels.where("relevance = 0").join(mined_q, "query_id", "left_anti"))
    return qrels.where("relevance <> 0").unionByName(kept_neg).unionByName(mined)


def rerank_pairs(run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 100) -> DataFrame:
    """(query text, document text) pairs of the first k of each query. No
    side of the joins is broadcast: a run's size is not known to the planner."""
    top = run.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    q = queries.select("query_id", F.col("text").alias("query_text"))
    d = corpus.select("doc_id", F.col("text").alias("doc_text"))
    return top.join(q.hint("merge"), "query_id").join(d.hint("merge"), "doc_id").select(
        "query_id", "doc_id", "rank", "query_text", "doc_text")


def rerank(run: DataFrame, pair_scores: DataFrame, k: int = 100) -> DataFrame:
    """Re-score the first k candidates with ``pair_scores(query_id,
    doc_id, score)``, sort by the new score (ties by doc_id) and cut to k.
    Candidates without a pair score are dropped."""
    top = run.where(F.col("rank") <= k).select("run_id", "query_id", "doc_id")
    scored = top.join(pair_scores.select("query_id", "doc_id", "score"),
                      ["query_id", "doc_id"])
    w = Window.partitionBy("run_id", "query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("run_id", "query_id", "doc_id", "score", "rank"))
