"""Cutting sorted rows into shards of about equal size, by exact byte counts.

Rows are ordered by ``key`` (``LEAST`` for null), then ``hash`` (of what else
orders them) and ``row`` (their place, for rows that may stand in any order), so
a key that many rows share is cut like any other."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = np.iinfo(np.int64).min
ORDER = ["key", "hash", "row"]


def _pieces(limit: int):
    """The rows at which pieces of about ``limit`` bytes of a sorted partition begin."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = limit
        for batch in batches:
            out = []
            for i, n in enumerate(batch.column("bytes").to_pylist()):
                if size >= limit:
                    out.append(i)
                    size = 0
                size += n + 1                            # an empty row takes room as well
            if out:
                yield batch.select(ORDER).take(pa.array(out))

    return cut


def shard_cuts(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """Where shards of rows ``(key, hash, row, bytes)`` begin, the first left out.
    Nothing else is sorted; one row a shard reaches the driver."""
    total = rows.agg(F.sum(F.col("bytes") + 1)).first()[0] or 0
    parts = max(1, -(-total // (16 * shard_bytes)))
    found = rows.repartitionByRange(int(parts), *ORDER).sortWithinPartitions(*ORDER).mapInArrow(
        _pieces(shard_bytes), "key long, hash long, row long").collect()
    return sorted(map(tuple, found))[1:]


def shard_of(batch: pa.RecordBatch, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """The shard of each row of a batch with the order's columns."""
    keys = np.array([c[0] for c in cuts], np.int64)
    key = batch.column("key").to_numpy()
    shard = np.searchsorted(keys, key, "left")
    for i in np.flatnonzero(shard < np.searchsorted(keys, key, "right")).tolist():
        shard[i] = bisect_right(cuts, tuple(batch.column(c)[i].as_py() for c in ORDER))
    return shard
