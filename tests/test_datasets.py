"""Imports, numbering, splits, sampling, stores, training rows (F7 quirks)."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retrievalkit.operators import sampling as U
from retrievalkit.operators import training as T
from retrievalkit.sources import imports as D
from retrievalkit.sources import store as ST
from retrievalkit.tables import RagTables


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 5000).select(
        F.col("id"), (F.col("id") * 7919 % 613).alias("k"), (F.col("id") % 3).alias("g"))
    got = U.dense_index(df, [F.col("k"), F.col("id")], num_partitions=6)
    want = df.withColumn("ord", F.row_number().over(Window.orderBy("k", "id")) - 1)
    assert got.select("id", "ord").exceptAll(want.select("id", "ord")).count() == 0
    got_g = U.dense_index(df, [F.col("k"), F.col("id")], partition_cols=["g"], num_partitions=5)
    want_g = df.withColumn("ord", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1)
    assert got_g.select("id", "ord").exceptAll(want_g.select("id", "ord")).count() == 0


def _queries(spark, n):
    return spark.createDataFrame([(f"q{i}", f"text {i}", i) for i in range(n)],
                                 "query_id string, text string, ord long")


def test_split_exact_size_and_order(spark):
    qs = _queries(spark, 1001)
    sp = U.split_train_val(qs, 0.1, 42)
    val = sp.where("split = 'val'").orderBy("ord").collect()
    train = sp.where("split = 'train'").orderBy("ord").collect()
    assert len(val) == int(1001 * 0.1) and len(train) == 1001 - len(val)
    assert {r.query_id for r in val}.isdisjoint({r.query_id for r in train})
    for part in (val, train):     # list order = dataset order, positions dense
        assert [r.ord for r in part] == list(range(len(part)))
        idx = [int(r.query_id[1:]) for r in part]
        assert idx == sorted(idx)
    with pytest.raises(ValueError):
        U.split_train_val(qs, 1.5)
    dev = U.split_dev(sp, 0.5, 42)
    assert dev.where("split = 'dev'").count() == math.ceil(len(train) / 2)
    assert dev.where("split = 'test'").count() == len(val)


def test_sample_docs(spark):
    c = spark.createDataFrame([(f"d{i}", "t") for i in range(50)], "doc_id string, text string")
    s = U.sample_docs(c, 20, 42).collect()
    assert len({r.doc_id for r in s}) == 20
    with pytest.raises(ValueError):
        U.sample_docs(c, 51)


def test_import_triples_first_query_wins_whole(spark):
    rows = [("Q1", "P1", "N1", 0), ("Q2", "P2", "P1", 1), ("Q1", "PX", "NX", 2), ("Q3", "N1", "P3", 3)]
    t = D.import_triples(spark, spark.createDataFrame(rows, "query string, positive string, negative string, ord long"))
    q = {r.query_id: r.text for r in t.queries.collect()}
    c = {r.doc_id: r.text for r in t.corpus.collect()}
    assert q == {"q-0": "Q1", "q-1": "Q2", "q-2": "Q3"}
    assert c == {"c-0": "P1", "c-1": "N1", "c-2": "P2", "c-3": "P3"}   # PX, NX never added
    rel = sorted(tuple(r) for r in t.qrels.collect())
    assert rel == sorted([("q-0", "c-0", 1), ("q-0", "c-1", 0), ("q-1", "c-2", 1), ("q-1", "c-0", 0),
                          ("q-2", "c-1", 1), ("q-2", "c-3", 0)])


def test_import_judged_rules(spark):
    corpus = spark.createDataFrame([("d1", "old", 0), ("d2", "x", 1), ("d1", "new", 2)], "id string, text string, o long")
    queries = spark.createDataFrame([("q1", "Q", 0)], "id string, text string, o long")
    judged = spark.createDataFrame([("q1", "d1", 1), ("q1", "d1", 1), ("q1", "d1", 0), ("q1", "d2", 0)],
                                   "qid string, docid string, relevance int")
    t = D.import_judged(spark, corpus, queries, judged, order_col="o")
    assert sorted(tuple(r) for r in t.corpus.collect()) == [("d1", "new", 0), ("d2", "x", 1)]
    assert t.qrels.count() == 3     # the pair judged both ways stays in both roles
    bad = spark.createDataFrame([("q1", "d1", 2)], "qid string, docid string, relevance int")
    with pytest.raises(Exception):
        D.import_judged(spark, corpus, queries, bad, order_col="o").qrels.collect()


def test_integrity_and_summary(spark):
    t = RagTables.create(
        spark,
        queries=_queries(spark, 2),
        corpus=spark.createDataFrame([("d1", "t", 0)], "doc_id string, text string, ord long"),
        qrels=spark.createDataFrame([("q0", "d1", 1), ("q0", "zz", 0), ("q9", "d1", 1)],
                                    "query_id string, doc_id string, relevance int"),
        splits=spark.createDataFrame([("q0", "val", 0), ("nope", "train", 0)],
                                     "query_id string, split string, ord long"))
    rep = sorted(tuple(r) for r in D.check_integrity(t).collect())
    assert rep == [("judged_query_missing", "q9"), ("negative_doc_missing", "zz"),
                   ("split_query_missing", "nope")]
    with pytest.raises(KeyError):
        D.assert_integrity(t)
    s = D.dataset_summary(t).first()
    assert (s.corpus, s.train_queries, s.val_queries) == (1, 1, 1)
    with pytest.raises(KeyError):
        U.select_split(t, "dev")


def test_rag_json_round_trip(spark, tmp_path):
    t = RagTables.create(
        spark,
        queries=spark.createDataFrame([("b", "问题二", 0), ("a", "q one", 1)], "query_id string, text string, ord long"),
        corpus=spark.createDataFrame([("c2", "docé", 0), ("c1", "doc", 1)], "doc_id string, text string, ord long"),
        qrels=spark.createDataFrame([("a", "c1", 1), ("a", "c2", 0)], "query_id string, doc_id string, relevance int"),
        splits=spark.createDataFrame([("b", "val", 0), ("a", "val", 1)], "query_id string, split string, ord long"))
    p = str(tmp_path / "ds")
    ST.write_rag_json(t, p)
    text = open(next((tmp_path / "ds").glob("part-*"))).read()
    assert "问题二" in text                       # non-ASCII kept raw
    back = ST.read_rag_json(spark, p)
    assert [tuple(r) for r in back.queries.orderBy("ord").collect()] == [("b", "问题二", 0), ("a", "q one", 1)]
    assert [tuple(r) for r in back.splits.orderBy("ord").collect()] == [("b", "val", 0), ("a", "val", 1)]
    assert back.answers.count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"queries": {}, "extra": 1}')
    with pytest.raises(Exception):
        ST.read_rag_json(spark, str(bad)).queries.collect()


def _train_tables(spark):
    return RagTables.create(
        spark,
        queries=_queries(spark, 3),
        corpus=spark.createDataFrame([(f"d{i}", f"doc {i}", i) for i in range(5)], "doc_id string, text string, ord long"),
        qrels=spark.createDataFrame(
            [("q0", "d0", 1), ("q0", "d1", 0), ("q0", "d2", 0), ("q1", "d3", 1), ("q2", "d4", 0)],
            "query_id string, doc_id string, relevance int"))


def test_negatives_oversampling_limit(spark):
    t = _train_tables(spark)
    negs = T.sample_negatives(t, 5).where("query_id = 'q0'").collect()
    assert len(negs) == 5 and sorted(r.slot for r in negs) == list(range(5))
    counts = {}
    for r in negs:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= math.ceil(5 / 2)


def test_training_rows_and_skips(spark):
    t = _train_tables(spark)
    rows, cols = T.training_rows(t, None, 2, "query: ", "passage: ")
    got = rows.collect()
    assert cols == ["query", "pos", "neg_0", "neg_1"]
    assert len(got) == 1 and got[0].query == "query: text 0" and got[0].pos == "passage: doc 0"
    assert {got[0].neg_0, got[0].neg_1} <= {"passage: doc 1", "passage: doc 2"}
    skipped = sorted(tuple(r) for r in T.skipped_queries(t, None, 2).collect())
    assert skipped == [("q1", "no_negative"), ("q2", "no_positive")]
