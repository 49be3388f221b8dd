"""IR metrics over run tables.

Rules (binary relevance):

* nDCG / MAP / recall / precision (M2-M5) count only queries that are in the
  run **and** have at least one relevant document; inside a query the order
  is score descending, then doc_id **descending** (the trec_eval tie rule).
  MAP divides by the number of relevant documents (not by min(k, R)),
  precision by k even when fewer than k documents were retrieved.
* MRR (M6) averages over **every** query of the run (no judgment -> 0) and
  keeps retrieval order on equal scores.

All metrics for all cutoffs come from one ``groupBy(run_id, query_id)`` with
conditional sums over one window pass; the only shuffles are by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_KS = (1, 3, 5, 10)
METRIC_NAMES = ("ndcg", "map", "recall", "precision", "mrr")


def build_qrels(qrels: DataFrame) -> DataFrame:
    """M1: relevant pairs of the whole dataset (not only one split)."""
    return (qrels.where("relevance = 1").select("query_id", "doc_id")
            .dropDuplicates().withColumn("relevance", F.lit(1)))


def num_relevant(qrels: DataFrame) -> DataFrame:
    return (qrels.where("relevance > 0").groupBy("query_id")
            .agg(F.countDistinct("doc_id").alias("num_rel")))


def judge_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows with ``rel`` (1 relevant, 0 otherwise) from qrels."""
    rel = (qrels.where("relevance > 0").select("query_id", "doc_id")
           .dropDuplicates().withColumn("rel", F.lit(1)))
    return run.join(rel, ["query_id", "doc_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(0)))


def judge_by_label(run: DataFrame, q_labels: DataFrame, d_labels: DataFrame,
                   exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Relevance = same label, without materialising label pairs.

    Returns the judged run and ``(query_id, num_rel)`` where num_rel is the
    size of the query's label group in the corpus (minus the query itself
    under leave-one-out). Cost: two lookups per run row and one count per
    label, never one row per relevant pair.
    """
    ql = q_labels.select("query_id", F.col("label").alias("q_label"))
    dl = d_labels.select("doc_id", F.col("label").alias("d_label"))
    judged = (run.join(ql, "query_id", "left").join(dl, "doc_id", "left")
              .withColumn("rel", F.coalesce((F.col("q_label") == F.col("d_label")).cast("int"),
                                            F.lit(0)))
              .drop("q_label", "d_label"))
    counts = d_labels.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))
    nr = ql.join(counts, ql.q_label == counts.label)
    if exclude_self:
        own = (ql.join(dl, (ql.query_id == dl.doc_id) & (ql.q_label == dl.d_label), "left_semi")
               .select("query_id", F.lit(1).alias("own")))
        nr = nr.join(own, "query_id", "left").withColumn(
            "n", F.col("n") - F.coalesce("own", F.lit(0)))
    nr = nr.select("query_id", F.col("n").alias("num_rel")).where("num_rel > 0")
    return judged, nr


def _idcg(k: int, num_rel: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), num_rel)), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))


def per_query_metrics(judged: DataFrame, num_rel: DataFrame, ks=DEFAULT_KS) -> DataFrame:
    """M7: one row per (run_id, query_id) with ``{metric}_at_{k}`` columns.

    ``judged`` holds ``run_id, query_id, doc_id, score, rank, rel``;
    ``num_rel`` holds ``query_id, num_rel``. nDCG/MAP/recall/precision are
    NULL for queries without relevant documents (they do not count); MRR is
    0 there.
    """
    ks = sorted(set(int(k) for k in ks))
    kmax = max(ks)
    if "run_id" not in judged.columns:
        judged = judged.withColumn("run_id", F.lit("run"))
    part = ["run_id", "query_id"]
    w_eval = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("doc_id").desc())
    w_retr = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("rank").asc(),
                                               F.col("doc_id").asc())
    cum = w_eval.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (judged
              .withColumn("er", F.row_number().over(w_eval))
              .withColumn("cum_rel", F.sum("rel").over(cum))
              .withColumn("mr", F.row_number().over(w_retr))
              .where((F.col("er") <= kmax) | (F.col("mr") <= kmax)))
    rel = F.col("rel") > 0
    aggs = []
    for k in ks:
        in_k = F.col("er") <= k
        aggs += [
            F.sum(F.when(in_k & rel, F.lit(1.0) / F.log2(F.col("er") + 1)).otherwise(0.0))
            .alias(f"_dcg_{k}"),
            F.sum(F.when(in_k & rel, F.col("cum_rel") / F.col("er")).otherwise(0.0))
            .alias(f"_ap_{k}"),
            F.sum(F.when(in_k & rel, 1).otherwise(0)).alias(f"_hits_{k}"),
            F.max(F.when((F.col("mr") <= k) & rel, F.lit(1.0) / F.col("mr"))).alias(f"_rr_{k}"),
        ]
    per_q = ranked.groupBy(*part).agg(*aggs).join(num_rel, "query_id", "left")
    nr = F.col("num_rel")
    has = nr.isNotNull() & (nr > 0)
    cols = [F.col("run_id"), F.col("query_id")]
    for name in METRIC_NAMES:
        for k in ks:
            if name == "ndcg":
                v = F.when(has, F.col(f"_dcg_{k}") / _idcg(k, nr))
            elif name == "map":
                v = F.when(has, F.col(f"_ap_{k}") / nr)
            elif name == "recall":
                v = F.when(has, F.col(f"_hits_{k}") / nr)
            elif name == "precision":
                v = F.when(has, F.col(f"_hits_{k}") / F.lit(float(k)))
            else:
                v = F.coalesce(F.col(f"_rr_{k}"), F.lit(0.0))
            cols.append(v.alias(f"{name}_at_{k}"))
    return per_q.select(*cols)


def metric_columns(ks=DEFAULT_KS) -> list[str]:
    ks = sorted(set(int(k) for k in ks))
    return [f"{m}_at_{k}" for m in METRIC_NAMES for k in ks]


def compute_metrics(per_query: DataFrame, ks=DEFAULT_KS, digits: int = 5) -> DataFrame:
    """M8: one row per run, means rounded to 5 decimals, columns in the
    order ndcg, map, recall, precision, mrr (each for all k).

    ``avg`` skips NULLs, so M2-M5 average over judged queries and MRR over all
    queries of the run, without a second pass.
    """
    names = metric_columns(ks)
    return per_query.groupBy("run_id").agg(
        *[F.round(F.avg(n), digits).alias(n) for n in names],
        F.count(F.lit(1)).alias("n_run_queries"),
        F.count(F.col(names[0])).alias("n_judged_queries"))


def long_metrics(metrics: DataFrame, ks=DEFAULT_KS) -> DataFrame:
    """Wide metrics row -> ``(run_id, metric, k, value)`` via unpivot."""
    names = metric_columns(ks)
    long = metrics.unpivot("run_id", names, "name", "value")
    return long.select(
        "run_id",
        F.regexp_extract("name", r"^([a-z]+)_at_", 1).alias("metric"),
        F.regexp_extract("name", r"_at_(\d+)$", 1).cast("int").alias("k"),
        "value")


def evaluate(run: DataFrame, qrels: DataFrame, ks=DEFAULT_KS) -> DataFrame:
    """M7 + M8 for runs judged by a qrels table."""
    pq = per_query_metrics(judge_run(run, qrels), num_relevant(qrels), ks)
    return compute_metrics(pq, ks)


def compare_runs(metrics: DataFrame, base_run: str, ks=DEFAULT_KS) -> DataFrame:
    """Every run's metrics next to the base run's, with the difference.

    Output long: ``(run_id, metric, k, value, base_value, delta)``.
    """
    long = long_metrics(metrics, ks)
    base = (long.where(F.col("run_id") == base_run)
            .select("metric", "k", F.col("value").alias("base_value")))
    return (long.join(F.broadcast(base), ["metric", "k"], "left")   # base: one run, <= 5*|ks| rows
            .withColumn("delta", F.round(F.col("value") - F.col("base_value"), 5)))


def compare_runs_wide(metrics: DataFrame, run_ids, ks=DEFAULT_KS) -> DataFrame:
    """M10, wide: one row per (metric, k), one column per run (explicit
    ``run_ids``, so the pivot needs no extra distinct job)."""
    long = long_metrics(metrics, ks)
    return (long.groupBy("metric", "k").pivot("run_id", list(run_ids))
            .agg(F.first("value")))
