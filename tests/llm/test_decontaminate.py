import random
from collections import Counter

from retrievalkit.llm.decontaminate import contained_items, decontaminated
from tests.conftest import SF001
from tests.llm.test_dedup import shingle_set


def brute(docs, items, k=5, percent=80):
    out = []
    for d, t in docs:
        words = (t or "").encode().lower().split()
        mine = shingle_set(t, k)
        for i, x in items:
            item = shingle_set(x, k)
            own = (x or "").encode().lower().split()
            if 0 < len(own) < k:
                shared = int(any(words[j:j + len(own)] == own for j in range(len(words))))
            else:
                shared = len(item & mine)
            if item and shared and 100 * shared >= percent * len(item):
                out.append((d, i, len(item), shared))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in df.collect())


def test_given_tables_match_brute_force(spark, docs001, texts001):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = brute(texts001.items(), items)
    assert want and found(contained_items(docs001, bench)) == want
    left = {r["doc_id"] for r in decontaminated(docs001, bench).collect()}
    assert left == set(texts001) - {d for d, *_ in want}


def test_short_repetitive_and_scattered_items(spark, messy):
    r = random.Random(2)
    long = [f"v{i}" for i in range(400)]
    filler = [f"f{r.randrange(10_000)}" for _ in range(5000)]
    items = [(1, "one two"), (2, "la la la la la la la la la la la la la la la la la la la la"), (3, " ".join(long[:60])),
             (4, None), (5, ""), (None, "g h i"), (6, " ".join(long[:30])), (7, "one")]
    docs = [(1, "x One\nTWO y"), (2, "la " * 50), (3, " ".join(filler[:2500] + long[:28] + filler[2500:4000] + long[28:60])),
            (4, " ".join(long[:29])), (5, " ".join(long[:20])), (6, None), (None, "f g h i j"), (7, "one"), (7, "one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "0 as n_shared")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found(contained_items(d, i)) == brute(docs, items)
    rows = [(x["doc_id"], x["text"]) for x in messy.collect()]
    assert found(contained_items(messy, i)) == brute(rows, items)
    assert decontaminated(messy, i).columns == messy.columns


def test_several_passes_give_the_same(spark, docs001, monkeypatch):
    from retrievalkit.llm import decontaminate as D

    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = found(contained_items(docs001, bench))
    monkeypatch.setattr(D, "ITEM_WORDS", 300)
    assert found(contained_items(docs001, bench)) == want


def test_empty_tables(spark, messy):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(messy, none).count() == 0
    assert decontaminated(messy, none).count() == messy.count()
    assert contained_items(messy.limit(0), none).count() == 0
