import random
import zlib
from collections import Counter

import numpy as np
import pytest

from retrievalkit.llm import token_files as B
from retrievalkit.llm import tokens as T
from retrievalkit.llm._spark import files_of, shared_folder


@pytest.fixture(scope="module")
def encode():
    whole = T.WordTokens(T.default_path()).whole
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids + [2]


def test_elias_fano():
    r = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (1, 1 << 62), (5, 3), (300, 10), (3000, 1 << 20), (2000, 1 << 50), (999, 0)):
        x = np.sort(r.integers(0, top + 1, n)) - (top // 3 if n else 0)
        code = B.EliasFano.encode(x)
        e = B.EliasFano(code)
        assert e.size == len(code) and e.n == n and e.all().tolist() == x.tolist()
        if n:
            i = r.integers(0, n, 500)
            assert e.select(i).tolist() == x[i].tolist()
            y = np.concatenate([x, x - 1, x + 1, r.integers(-5, top + 5, 50)])
            assert e.last_at_most(y).tolist() == (np.searchsorted(x, y, "right") - 1).tolist()
            # near the least space: log2(top / n) + 2 bits an entry, and the samples
            assert 8 * len(code) <= n * (max(0, np.log2((top + 1) / n)) + 3.2) + 64 * 5


def brute(rows, encode):
    """Rows in ascending order of id, nulls first; those of one id in any order."""
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = encode(t)
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, docs001, texts001, encode):
    want = brute(list(texts001.items()), encode)
    for size in (16 << 20, 20_000):
        folder = shared_folder(spark, "ids")
        manifest = B.write_ids(docs001, folder, shard_bytes=size).collect()
        assert (len(manifest) == 1) == (size > 1 << 20)
        got = B.read_documents(spark, folder).selectExpr("id", "start", "n_tokens", "crc32(ids)").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        store, path = files_of(folder)
        ids = b"".join(store.open_input_stream(f"{path}/{m['name']}.ids").read() for m in sorted(manifest))
        assert len(ids) == 2 * sum(n for _, _, n, _ in want)          # the array itself, end to end
        with pytest.raises(FileExistsError):
            B.write_ids(docs001, folder)
        r = random.Random(1)
        asked = [r.randrange(len(ids) // 2) for _ in range(300)] + [0, len(ids) // 2 - 1, len(ids) // 2, -1, None]
        ends = np.cumsum([n for _, _, n, _ in want])
        for a in B.locate(spark, folder, spark.createDataFrame([(p,) for p in asked], "position long")).collect():
            p = a["position"]
            if p is None or not 0 <= p < len(ids) // 2:
                assert a["id"] is None and a["offset"] is None
            else:
                doc, start, *_ = want[int(np.searchsorted(ends, p, "right"))]
                assert (a["id"], a["offset"]) == (doc, p - start)


def test_same_files_from_any_layout(spark, docs001):
    shas = []
    for df in (docs001, docs001.repartition(7).withColumn("id", docs001["n_chars"])):
        folder = shared_folder(spark, "ids")
        shas.append([(m["name"], m["sha256"]) for m in B.write_ids(df, folder, shard_bytes=60_000).orderBy("shard").collect()])
    assert len(shas[0]) > 3 and shas[0] == shas[1]


def test_one_key_of_many_rows(spark, encode):
    """A third of all rows share an id, and most of these their text: they are
    cut into shards like any others."""
    rows = [(i, f"text {i} of some words") for i in range(400)]
    rows += [(77, "the same text on many rows")] * 300 + [(77, f"own text {i}") for i in range(100)]
    rows += [(None, "without an id")] * 100 + [(-5, None), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    random.Random(3).shuffle(rows)
    folder = shared_folder(spark, "ids")
    manifest = B.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder, shard_bytes=1000)
    assert manifest.agg({"documents": "max"}).first()[0] < 200
    got = [tuple(r) for r in B.read_documents(spark, folder).selectExpr("id", "start", "n_tokens", "crc32(ids)").collect()]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, n, c) for d, _, n, c in brute(rows, encode))
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda d: -(1 << 63) if d is None else d)


def test_messy_and_empty(spark, messy, encode):
    folder = shared_folder(spark, "ids")
    B.write_ids(messy, folder)
    got = [tuple(r) for r in B.read_documents(spark, folder).selectExpr("id", "n_tokens", "crc32(ids)").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in messy.collect()], encode)
    assert Counter(got) == Counter((d, n, c) for d, _, n, c in want)
    folder = shared_folder(spark, "ids")
    assert B.write_ids(messy.limit(0), folder).count() == 0
    assert B.read_documents(spark, folder).count() == 0
    asked = spark.createDataFrame([(0,)], "position long")
    assert [tuple(r) for r in B.locate(spark, folder, asked).collect()] == [(0, None, None)]
