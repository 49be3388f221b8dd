"""The embedding store: lookups by bucket, concurrent writers, compaction."""

import threading

import pytest

from retrievalkit.operators import embed as E
from retrievalkit.operators import embed_store as S
from tests.test_plans import plan

ROW = "model string, role string, instruction string, normalize boolean, text_md5 string, vec array<float>"


def rows(spark, keys, value=1.0, model="m"):
    return spark.createDataFrame([(model, "corpus", "", True, k, [value]) for k in keys], ROW)


def keys_in(spark, store):
    with S.stored(spark, store) as known:
        return sorted(r.text_md5 for r in known.collect()) if known is not None else []


def test_a_lookup_shuffles_the_texts_alone(spark, tmp_path):
    store = str(tmp_path / "store")
    for part in (range(0, 300), range(300, 500)):
        S.append(rows(spark, [f"k{i:03d}" for i in part]), store, buckets=8)
    wanted = spark.createDataFrame([(str(i), f"k{i:03d}") for i in range(0, 600, 7)], "id string, text_md5 string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with S.stored(spark, store) as known:
            p = plan(wanted.join(known.select("text_md5", "vec"), "text_md5", "left"))
        got = S.lookup(wanted, store, "m", "corpus", "", True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.split("\n\n")[0].count("Exchange") == 1 and "Bucketed: true" in p
    assert {r.id for r in got if r.vec is not None} == {str(i) for i in range(0, 500, 7)}
    assert len(got) == len(range(0, 600, 7))
    other = S.lookup(wanted, store, "other", "corpus", "", True)
    assert other.where("vec is not null").count() == 0


def test_writers_at_once_lose_nothing_and_repeat_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    parts = [[f"k{i}" for i in range(a, a + 40)] for a in (0, 20, 40, 60)]      # overlapping
    work = [threading.Thread(target=S.append, args=(rows(spark, p), store, 4)) for p in parts]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert keys_in(spark, store) == sorted({k for p in parts for k in p})


def test_a_batch_without_mark_is_not_read(spark, tmp_path):
    store = str(tmp_path / "store")
    assert keys_in(spark, store) == []
    S.append(rows(spark, ["a"]), store, 4)
    dead = S.append(rows(spark, ["b"]), store, 4)
    (tmp_path / "store" / f"batch={dead}" / "_SUCCESS").unlink()
    assert keys_in(spark, store) == ["a"]


def test_first_batches_with_unlike_bucket_counts(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    keys = [f"k{i}" for i in range(40)]
    with monkeypatch.context() as m:
        m.setattr(S, "_names", lambda spark, store: [])        # neither writer sees the other
        S.append(rows(spark, keys[:25]), store, 4)
        S.append(rows(spark, keys[15:]), store, 16)
    assert keys_in(spark, store) == sorted(keys)
    S.compact(spark, store)
    assert len(S.batches(spark, store)) == 1 and keys_in(spark, store) == sorted(keys)


def test_compaction_keeps_the_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    names = [S.append(rows(spark, ks), store, 4) for ks in (["a", "b"], ["b", "c"], ["d"])]
    S.append(rows(spark, ["a"], 2.0, "n"), store)
    new = S.compact(spark, store)
    assert S.batches(spark, store) == [new] and set(names) < set(S.unused_batches(spark, store))
    assert keys_in(spark, store) == ["a", "a", "b", "c", "d"]
    late = S.append(rows(spark, ["e"]), store)
    assert S.batches(spark, store) == sorted([new, late]) and new.startswith("00004-")
    assert S.compact(spark, str(tmp_path / "none")) is None


def test_incremental_calls_encode_each_text_once(spark, tmp_path):
    seen = []

    def fn(df):
        seen.append(sorted(r.text for r in df.select("text").collect()))
        return E.hash_embed(df, 4)

    store = str(tmp_path / "it's a store")
    for texts in (["x", "y", "x"], ["y", "z"], ["x", "y", "z", None]):
        docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
        out = E.embed_incremental(docs, store, "m", embed_fn=fn)
        want = E.hash_embed(docs, 4)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
        S.compact(spark, store)
    assert seen == [["x", "y"], ["z"], [""]]
    with pytest.raises(Exception):
        bad = tmp_path / "file"
        bad.write_text("no store")
        E.embed_incremental(docs, str(bad), "m", embed_fn=fn)
