"""Scale properties read from the physical plans (not just results)."""

import contextlib
import io

from pyspark.sql import functions as F

from retrievalkit.operators import sampling as U
from retrievalkit.operators import search as R
from retrievalkit.operators import training as T
from retrievalkit.sources import testdata
from tests.conftest import SF01


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def vecs(spark):
    return testdata.vectors(spark, SF01).select("id", "vec")


def test_knn_limits_before_the_exchange_and_prunes_the_scan(spark):
    p = plan(R.knn(vecs(spark), vecs(spark), 10, "cosine", group_bytes=64 << 10))   # 500 x 64 x 8 = 250 KiB
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "MapInArrow" in p and "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "Scan parquet" not in p and "Range" in p      # tasks are numbers; each reads its block files


def test_knn_plan_does_not_grow_with_the_groups(spark):
    v = vecs(spark)
    one, many = (plan(R.knn(v, v, 10, "dot", group_bytes=n)) for n in (128 << 10, 4 << 10))   # 2 groups and 63
    nodes = lambda p: [line.split("(")[0].strip(" +-:*") for line in p.split("\n\n")[0].splitlines()]
    assert nodes(one) == nodes(many) and many.count("MapInArrow") == one.count("MapInArrow")


def test_vectors_do_not_pass_the_driver(spark, monkeypatch):
    """What comes to the driver of a search is a path and two numbers a block."""
    v, seen = vecs(spark), []
    frame, collect = type(v), type(v).collect
    monkeypatch.setattr(frame, "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("toArrow")))
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(self.dtypes) or collect(self))
    R.knn(v, v.where("id <> '3'"), 3, "cosine")
    assert seen == [[("path", "string"), ("rows", "int"), ("dim", "int")]] * 2


def test_dense_index_has_no_window_over_data_rows(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 17).alias("k"))
    p = plan(U.dense_index(df, [F.col("k"), F.col("id")]))
    # the only window runs over the per-partition counts (after an aggregate)
    assert p.count("Window (") <= 1
    assert "BroadcastExchange" in p or "BroadcastHashJoin" in p


def test_negatives_limit_before_shuffle(spark):
    from retrievalkit.plans import text_eval as TX

    t = TX.dataset(spark, SF01, splits=False)
    p = plan(T.sample_negatives(t, 3))
    assert "WindowGroupLimit" in p



def test_found_rows_are_not_broadcast(spark):
    """a search looks as small as its task numbers, so its rows were
    collected on the driver and broadcast to join them with texts and lists."""
    from retrievalkit.operators import topk as K
    from retrievalkit.operators import training as T
    from retrievalkit.tables import RagTables

    v = vecs(spark)
    run = R.retrieve(v, v, 10, metric="cosine")
    texts = lambda c: v.select(F.col("id").alias(c), F.col("id").alias("text"), F.lit(0).alias("ord"))
    q, d = texts("query_id"), texts("doc_id")
    plans = [R.rerank_pairs(run, q, d), T.scored_pairs(run, RagTables.create(spark, queries=q, corpus=d)),
             run.join(q, "query_id"), q.join(K._lists(run, "cosine"), "query_id", "left")]
    for df in plans:
        assert "BroadcastExchange" not in plan(df), plan(df)
        assert "SortMergeJoin" in plan(df)


def test_small_groups_share_tasks_and_pairs_bound_them(spark):
    """every group of 64 queries read all blocks anew. F19, F21: the number
    of tasks did not grow with the pairs, so the tasks did."""
    from retrievalkit.operators.vector_files import pair_tasks, write_vectors

    v = vecs(spark)
    blocks = write_vectors(v, block_rows=50)                         # 500 vectors
    few = R.search_blocks(blocks, blocks, 5, group_bytes=4 << 10)    # 8 queries a group
    assert R.scan_report(blocks, blocks, 5, group_bytes=4 << 10).first()["pairs"] == 500 * 500
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(few) == rows(R.search_blocks(blocks, blocks, 5))

    def tasks(group, **how):
        return pair_tasks(blocks, 64, group, blocks, 64, "n long", lambda groups, files: iter(()), **how).rdd.getNumPartitions()

    slots = spark.sparkContext.defaultParallelism
    assert tasks(8, bundle_rows=500) <= 2 * slots + 1 < tasks(8)
    assert tasks(500, task_pairs=500 * 50) == 10
