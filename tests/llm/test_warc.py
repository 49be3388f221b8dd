import hashlib

import pytest

from retrievalkit.llm._spark import shared_folder
from retrievalkit.llm.warc import read_warc, write_warc

LONG = "<p>" + "x" * 200


def plan(rows):
    """Expected ``(key, bytes, digest, kind, refers_to)`` by brute force."""
    first, out, seen = {}, [], set()
    for k, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if len((h or "").encode()) >= 100 and k is not None:
            first[d] = min(k, first.get(d, k))
    for k, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        f = first.get(d)
        again = (k, d) in seen
        seen.add((k, d))
        refers = None if f is None or (k == f and not again) else f
        out.append((k, len(b), d, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def got(spark, folder):
    rows = read_warc(spark, folder).collect()
    assert all(r["intact"] for r in rows)
    return rows, sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in rows), key=repr)


def test_round_trip(spark):
    rows = [(5, "http://a/", LONG), (3, "http://b/", LONG), (3, "http://b2/", LONG), (9, None, None), (8, "http://c/\r\nX: y", ""),
            (7, "u", "short"), (6, "u", "short"), (None, "n", LONG), (None, None, "é" * 60), (None, "m", "é" * 60),
            (1, "big", "z\r\n\r\nq" * 200_000), (2, "w", "WARC/1.0\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as kind", "3 as shard")
    folder = shared_folder(spark, "warc-test")
    manifest = write_warc(df, folder, roll_bytes=2000).collect()
    assert len(manifest) > 1 and sum(m["records"] for m in manifest) == len(rows)
    read, summary = got(spark, folder)
    assert summary == plan(rows)
    texts = {(r["key"], r["uri"]): r["payload"] for r in read if r["kind"] == "response"}
    assert bytes(texts[1, "big"]).decode() == rows[10][2] and bytes(texts[8, "http://c/ X: y"]) == b""
    with pytest.raises(FileExistsError):
        write_warc(df, folder)


def test_same_rows_same_files(spark):
    df = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url",
                                     "repeat(cast(id % 40 as string), 120) as html")
    a, b = shared_folder(spark, "w1"), shared_folder(spark, "w2")
    one = write_warc(df, a, roll_bytes=4000, shard_bytes=9000).collect()
    two = write_warc(df.repartition(5, "html"), b, roll_bytes=4000, shard_bytes=9000).collect()
    assert len({m["shard"] for m in one}) >= 5
    assert sorted(one) == sorted(two) and len(one) > 1
    assert got(spark, a)[1] == got(spark, b)[1]
    # files outside the manifest do not count
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(a)
    with store.open_output_stream(f"{path}/shard-999999-00000.warc.gz", compression=None) as f:
        f.write(b"broken")
    assert got(spark, a)[1] == got(spark, b)[1]
    ranges = sorted((m["first_key"], m["last_key"]) for m in one)
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))


def test_empty(spark):
    folder = shared_folder(spark, "warc-none")
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert read_warc(spark, folder).count() == 0


def test_one_key_of_many_rows(spark):
    """A key with a third of the rows is cut into several shards like any other."""
    rows = [(i, "u", f"<p>{i}" + "y" * 150) for i in range(200)] + [(77, "u", f"<p>own {i}" + "z" * 150) for i in range(100)]
    rows += [(77, "u", "<p>same" + "z" * 150)] * 5 + [(None, "u", f"<p>none {i % 50}" + "z" * 150) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = shared_folder(spark, "warc-hot")
    manifest = write_warc(df, folder, shard_bytes=4000).collect()
    assert max(m["records"] for m in manifest) < 60 and sum(m["first_key"] == 77 == m["last_key"] for m in manifest) > 1
    assert got(spark, folder)[1] == plan(rows)


def test_reading_takes_time_in_proportion():
    """Members of a file of four times the size take about four times as long."""
    import gzip
    import os
    import time

    from retrievalkit.llm.warc import _members

    def seconds(n):
        member = gzip.compress(os.urandom(4000), 1)
        data = memoryview(member * (n // len(member)))
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert sum(1 for _ in _members(data)) == n // len(member)
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(16 << 20) < 10 * seconds(4 << 20)
