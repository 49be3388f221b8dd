"""Exact shares drawn by counting key prefixes, against a sort of all keys."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from retrievalkit.operators import sampling as U
from tests.test_plans import plan


def order(ids, salt, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{salt}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("digits,leaf", [(4, 10_000), (1, 0), (1, 3), (2, 5)])
def test_the_first_keys_are_those_of_a_sort(spark, monkeypatch, digits, leaf):
    monkeypatch.setattr(U, "_DIGITS", digits)
    monkeypatch.setattr(U, "_LEAF", leaf)
    ids = [f"doc{i}" for i in range(300)]
    df = spark.createDataFrame([(i, i.upper()) for i in ids], "doc_id string, text string").repartition(5).checkpoint()
    for k in (0, 1, 2, 57, 150, 299, 300):
        got = U.sample_docs(df, k)
        assert got.columns == ["doc_id", "text"]
        assert sorted(r.doc_id for r in got.collect()) == sorted(order(ids, "sample")[:k])
        assert "Exchange" not in plan(got) and "Sort" not in plan(got)
    with pytest.raises(ValueError):
        U.sample_docs(df, 301)


def test_splits_have_exact_sizes_and_keep_their_order(spark):
    ids = [f"q-{i}" for i in range(101)]
    qs = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "query_id string, ord long")
    sp = U.split_train_val(qs, 0.3).collect()
    val = set(order(ids, "split")[:30])
    for split, own in (("val", val), ("train", set(ids) - val)):
        rows = sorted((r.ord, r.query_id) for r in sp if r.split == split)
        assert [q for _, q in rows] == [i for i in ids if i in own]
        assert [o for o, _ in rows] == list(range(len(own)))
    dev = U.split_dev(U.split_train_val(qs, 0.3).checkpoint(), 0.5)
    train = set(ids) - val
    assert {r.query_id for r in dev.where("split = 'dev'").collect()} == set(
        order(train, "dev")[:math.ceil(len(train) * 0.5)])
    assert {r.query_id for r in dev.where("split = 'test'").collect()} == val
    assert "Exchange" not in plan(dev)


def test_null_repeated_and_no_ids(spark):
    rows = [("a",), ("b",), (None,), ("c",), ("c",)]
    df = spark.createDataFrame(rows, "doc_id string")
    assert sorted(r.doc_id for r in U.sample_docs(df, 4).collect()) == ["a", "b", "c", "c"]
    with pytest.raises(ValueError):
        U.sample_docs(df, 5)
    cond = U.first_keys(df.limit(0), F.md5("doc_id"), "doc_id", lambda n: n)
    assert df.where(cond).count() == 0
    one = spark.createDataFrame([("x",)] * 6, "doc_id string")      # one key: all or none
    assert U.sample_docs(one, 2).count() == 6
