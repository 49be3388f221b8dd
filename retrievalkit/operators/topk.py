"""An exact run that is kept up to date while the corpus changes.

The state holds one row per query: its best ``depth`` documents in rank order
and whether that list is ``complete`` (holds every document the query can
find). What follows is exact, ties included:

* New documents are searched alone. In a complete list they merge freely. In
  any other list a new document counts only if it ranks before the last one
  stored: behind that place old documents that were never stored may come.
* Documents that leave are taken out of the lists. What remains of a list is
  still the front of the full ranking, only shorter.
* A list that is neither complete nor as long as ``k`` is searched again over
  the whole corpus, that query alone. ``depth - k`` is thus the number of a
  query's documents that may leave before the corpus is read again.

A changed vector is a document that leaves and one that comes. Vectors that R1
leaves out are left out here too; a query without a usable vector has no list.
An id is in the corpus at most once: callers check it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievalkit.operators.search import search_blocks, similarity_from_distance
from retrievalkit.operators.vector_files import VectorBlocks, write_vectors
from retrievalkit.session import materialised

_TOP = "array<struct<o: double, doc_id: string>>"


@dataclass(frozen=True)
class KeptRun:
    """Lists ``(query_id, top, complete)``, the queries' vectors ``(id, vec)``
    and their block files. ``top`` holds ``(o, doc_id)`` in rank order, ``o``
    the score with its sign turned so that smaller is better."""

    lists: DataFrame
    query_vecs: DataFrame
    blocks: VectorBlocks
    k: int
    depth: int
    metric: str


def _sign(metric: str) -> int:
    return 1 if metric == "sq_l2" else -1


def _lists(found: DataFrame, metric: str) -> DataFrame:
    """One list per query of R1's rows; a list has at most ``depth`` entries."""
    o = F.lit(0.0) + F.lit(_sign(metric)) * F.col("score")       # no negative zero
    return found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(o.alias("o"), "doc_id"))).cast(_TOP).alias("found")).hint("merge")


def start_run(query_vecs: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", *,
              spare: int | None = None) -> KeptRun:
    """The lists of all queries ``(id, vec)`` over a first corpus ``(id, vec)``,
    with ``spare`` places beyond ``k`` (default: as many as ``k``). The corpus
    may be empty; query ids are unique."""
    depth = k + (k if spare is None else spare)
    query_vecs = materialised(query_vecs.select(F.col("id").cast("string").alias("id"), "vec"), "run-queries")
    blocks = write_vectors(query_vecs)
    found = _lists(search_blocks(blocks, write_vectors(corpus), depth, metric), metric)
    lists = query_vecs.select(F.col("id").alias("query_id")).join(found, "query_id", "left").select(
        "query_id", F.coalesce("found", F.array().cast(_TOP)).alias("top"))
    lists = lists.withColumn("complete", F.size("top") < depth)
    return KeptRun(materialised(lists, "run-lists"), query_vecs, blocks, k, depth, metric)


def _merged(top: Column, found: Column, complete: Column) -> Column:
    last = F.element_at(top, -1)
    sure = F.when(complete, found).when(
        F.size(top) > 0, F.filter(found, lambda x: x < last)).otherwise(F.array().cast(_TOP))
    return F.array_sort(F.concat(top, sure))


def insert_docs(run: KeptRun, new_docs: DataFrame) -> KeptRun:
    """The run after the documents ``(id, vec)`` came. Reads the lists, the
    queries' blocks and the new documents; never the old corpus."""
    found = _lists(search_blocks(run.blocks, write_vectors(new_docs), run.depth, run.metric), run.metric)
    both = run.lists.join(found, "query_id", "left").withColumn(
        "found", F.coalesce("found", F.array().cast(_TOP)))
    both = both.select(
        "query_id", _merged(F.col("top"), F.col("found"), F.col("complete")).alias("all"),
        (F.col("complete") & (F.size("found") < run.depth)).alias("whole"))
    lists = both.select("query_id", F.slice("all", 1, run.depth).alias("top"),
                        (F.col("whole") & (F.size("all") <= run.depth)).alias("complete"))
    return replace(run, lists=materialised(lists, "run-lists"))


def remove_docs(run: KeptRun, gone: DataFrame, corpus: DataFrame) -> KeptRun:
    """The run after the documents with the ids ``gone`` (column ``id``, in any
    number) left; ``corpus`` is what remains and is read only if some list is
    too short afterwards."""
    ids = gone.select(F.col("id").cast("string").alias("doc_id"))
    lost = (run.lists.select("query_id", F.explode("top.doc_id").alias("doc_id"))
            .join(ids, "doc_id", "left_semi").groupBy("query_id").agg(F.collect_set("doc_id").alias("lost")))
    kept = F.when(F.col("lost").isNull(), F.col("top")).otherwise(
        F.filter("top", lambda x: ~F.array_contains("lost", x["doc_id"])))
    lists = materialised(run.lists.join(lost, "query_id", "left").select(
        "query_id", kept.alias("top"), "complete"), "run-lists")
    return refill(replace(run, lists=lists), corpus)


def short_lists(run: KeptRun) -> DataFrame:
    """The queries whose lists no longer tell their best ``k``."""
    return run.lists.where(~F.col("complete") & (F.size("top") < run.k)).select("query_id")


def refill(run: KeptRun, corpus: DataFrame) -> KeptRun:
    """Lists that are too short, searched again over the whole ``corpus``."""
    short = short_lists(run)
    if short.isEmpty():
        return run
    ids = short.withColumnRenamed("query_id", "id")
    # such a query had a list once, so its vector has the length of most
    again = write_vectors(run.query_vecs.join(ids, "id", "left_semi"))
    found = _lists(search_blocks(again, write_vectors(corpus), run.depth, run.metric), run.metric)
    new = short.join(found, "query_id", "left").select(
        "query_id", F.coalesce("found", F.array().cast(_TOP)).alias("top"))
    new = new.withColumn("complete", F.size("top") < run.depth)
    lists = run.lists.join(short, "query_id", "left_anti").unionByName(new)
    return replace(run, lists=materialised(lists, "run-lists"))


def run_rows(run: KeptRun, k: int | None = None) -> DataFrame:
    """R1's rows ``(query_id, doc_id, score, rank)`` of the first ``k`` places."""
    k = run.k if k is None else k
    if k > run.k:
        raise ValueError(f"the run keeps {run.k} places, not {k}")
    at = run.lists.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("p", "t"))
    score = F.lit(0.0) + F.lit(_sign(run.metric)) * F.col("t.o")
    return at.select("query_id", F.col("t.doc_id").alias("doc_id"), score.alias("score"),
                     (F.col("p") + 1).alias("rank"))


def run_table(run: KeptRun, run_id: str = "run") -> DataFrame:
    """The run as R2 gives it: ``(run_id, query_id, doc_id, score, rank)``."""
    rows = run_rows(run)
    if run.metric == "sq_l2":
        rows = similarity_from_distance(rows)
    return rows.select(F.lit(run_id).alias("run_id"), "query_id", "doc_id", "score", "rank")


def best_of(run: KeptRun, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: the best document of the queries ``id``."""
    wanted = queries.select(F.col("id").alias("query_id"))
    return run_rows(run, 1).join(wanted, "query_id", "left_semi").select("query_id", "doc_id", "score")


__all__ = ["KeptRun", "start_run", "insert_docs", "remove_docs", "refill", "short_lists", "run_rows",
           "run_table", "best_of"]
