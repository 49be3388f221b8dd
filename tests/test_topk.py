"""Runs kept up to date against a full search after every change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievalkit.operators import nudge as N
from retrievalkit.operators import search as R
from retrievalkit.operators import topk as K
from tests.test_plans import plan

VEC = "id string, vec array<float>"


def rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def vectors(spark, items):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in items], VEC)


def small(rng, prefix, n, dim=3):
    """Few different values: many equal scores; some zero, null and odd vectors."""
    out = [(f"{prefix}{i:03d}", rng.integers(-1, 3, dim).tolist()) for i in range(n)]
    return out + [(f"{prefix}zero", [0] * dim), (f"{prefix}null", None), (f"{prefix}odd", [1.0] * (dim + 1)),
                  (f"{prefix}nan", [float("nan")] + [1.0] * (dim - 1))]


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
@pytest.mark.parametrize("spare", [0, 2])
def test_every_change_equals_a_full_search(spark, metric, spare):
    rng = np.random.default_rng(7)
    q = vectors(spark, small(rng, "q", 12))
    docs = dict(small(rng, "d", 9))
    run = K.start_run(q, vectors(spark, docs.items()), 4, metric, spare=spare)

    def check():
        c = vectors(spark, docs.items())
        assert rows(K.run_rows(run)) == rows(R.knn(q, c, 4, metric))

    check()
    for step in range(3):
        new = dict(small(rng, f"n{step}", 6))
        docs |= new
        run = K.insert_docs(run, vectors(spark, new.items()))
        check()
        gone = [i for i in docs if rng.random() < 0.4]
        docs = {i: v for i, v in docs.items() if i not in gone}
        run = K.remove_docs(run, vectors(spark, [(i, None) for i in gone] + [("unknown", None)]),
                            vectors(spark, docs.items()))
        check()


def test_empty_corpus_queries_and_changes(spark):
    none = vectors(spark, [])
    q = vectors(spark, [("a", [1, 0]), ("b", [0, 1])])
    run = K.start_run(q, none, 2, "dot")
    assert rows(K.run_rows(run)) == []
    run = K.insert_docs(K.insert_docs(run, none), vectors(spark, [("x", [2, 1])]))
    assert rows(K.run_rows(run)) == [("a", 1, "x", 2.0), ("b", 1, "x", 1.0)]
    run = K.remove_docs(run, vectors(spark, [("x", None)]), none)
    assert rows(K.run_rows(run)) == []
    assert rows(K.run_rows(K.insert_docs(K.start_run(none, none, 2), q))) == []
    with pytest.raises(ValueError):
        K.run_rows(run, 3)


def test_corpus_is_read_only_for_lists_that_are_too_short(spark, monkeypatch):
    """Every id is d0 .. d39 by score; the corpus is searched again once the
    spare places are used up, and then by the affected query alone."""
    q = vectors(spark, [("low", [1]), ("high", [-1])])
    docs = [(f"d{i:02d}", [i + 1]) for i in range(40)]
    run = K.start_run(q, vectors(spark, docs), 3, "dot", spare=2)
    written = []
    monkeypatch.setattr(K, "write_vectors", lambda df: written.append(df.count()) or R.write_vectors(df))
    run = K.insert_docs(run, vectors(spark, [("e", [0.5])]))
    assert written == [1]                                       # the new document only
    run = K.remove_docs(run, vectors(spark, docs[38:]), vectors(spark, docs[:38]))
    assert written == [1]
    run = K.remove_docs(run, vectors(spark, docs[37:38]), vectors(spark, docs[:37] + [("e", [0.5])]))
    assert written == [1, 1, 38]                                # one query, the corpus
    assert [r[2] for r in rows(K.run_rows(run)) if r[0] == "low"] == ["d36", "d35", "d34"]


def test_nudge_insert_by_the_kept_run(spark):
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    D, Q = unit(rng.normal(size=(30, 4))), unit(rng.normal(size=(24, 4)))
    dv = vectors(spark, [(f"d{i:02d}", D[i]) for i in range(30)])
    qv = vectors(spark, [(f"q{i:02d}", Q[i]) for i in range(24)])
    qrels = spark.createDataFrame([(f"q{i:02d}", f"d{i % 30:02d}", 1) for i in range(24)],
                                  "query_id string, doc_id string, relevance int")
    splits = qrels.select("query_id", F.when(F.col("query_id") < "q14", "train").otherwise("val").alias("split"))
    old, new = dv.where("id < 'd10' or id >= 'd20'"), dv.where("id between 'd10' and 'd19'")
    for kind in N.KINDS:
        want, gamma = N.nudge_insert(old, new, qv, qrels, splits, kind)
        run = K.start_run(qv, old, 5, N.search_metric(kind))
        got, gamma_kept, run = N.nudge_insert_kept(run, old, new, qrels, splits, kind)
        assert gamma_kept == gamma
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert rows(K.run_rows(run)) == rows(R.knn(qv, want, 5, N.search_metric(kind)))
        with pytest.raises(ValueError):
            N.nudge_insert_kept(run, got, new, qrels, splits, kind)          # ids in both
    with pytest.raises(ValueError):
        N.nudge_insert_kept(run, old, new, qrels, splits, "nudge-n")         # a run by another metric


def test_the_plan_of_a_merge_pairs_by_key(spark):
    q = vectors(spark, [("a", [1, 0])])
    p = plan(K.run_rows(K.insert_docs(K.start_run(q, q, 2), q.select(F.lit("z").alias("id"), "vec"))))
    assert "NestedLoopJoin" not in p and "Cartesian" not in p
