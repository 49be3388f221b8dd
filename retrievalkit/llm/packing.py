"""Sum-of-squares online packing of documents into windows of fixed length.

Documents are cut into whole windows and a rest. The rests of a shard arrive in
hash order and each is placed at once: of the fill levels that hold a partly
filled window (or a new window), the one is taken that minimises the sum of
squared counts of windows per level after the move. The counts are one array by
level, so a placement is a few vector operations, and the rule drives windows
to meet exactly at full.

Windows still open when a shard ends are closed without padding: their rests
are cut at powers of two, and these parts, largest first, fill windows exactly;
what is left at the end of the shard is one sequence per binary digit, and such
sequences need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare, stored, text_of
from retrievalkit.llm.tokens import default_path, word_tokens

_PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _parts(rest: int) -> list[int]:
    """Powers of two that sum to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(path: str, window: int, end_id: int):
    """Per document its length in ids and the checksums of its possible pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = word_tokens(path), 0
        for batch in batches:
            for lo, hi, ids, off in tokens.encode(batch.column(1)):
                size, full, rest, parts = [], [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    data = np.append(ids[a:b], end_id).astype("<u4").tobytes()
                    n = b - a + 1
                    cuts = n - n % window
                    size.append(n)
                    full.append([zlib.crc32(data[4 * i:4 * (i + window)]) for i in range(0, cuts, window)])
                    rest.append(zlib.crc32(data[4 * cuts:]))
                    at, own = cuts, []
                    for p in _parts(n - cuts):
                        own.append(zlib.crc32(data[4 * at:4 * (at + p)]))
                        at += p
                    parts.append(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                    pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int64()),
                    pa.array(parts, pa.list_(pa.int64())), pa.array(range(row, row + hi - lo), pa.int64())],
                    names=["id", "n", "full", "rest", "parts", "row"])
                row += hi - lo

    return cut


def place(sizes: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """``(window, offset)`` of each size (1 to ``window - 1``) in order of arrival,
    and how many windows were begun."""
    count = np.zeros(window + 1, np.int64)              # windows by fill; 0 and full stay at 0
    level: list[list[int]] = [[] for _ in range(window)]
    out, begun = [], 0
    top = np.iinfo(np.int64).max
    for s in sizes:
        here = count[:window + 1 - s]
        cost = 2 * (count[s:] - here)
        cost[here == 0] = top
        cost[0] = 2 * count[s] - 1 if s < window else -1   # a new window
        if s < window and count[window - s]:
            cost[window - s] -= 1                       # a full window is no longer counted
        best = int(len(cost) - 1 - np.argmin(cost[::-1]))   # of equal costs the fullest
        if best:
            w = level[best].pop()
            count[best] -= 1
        else:
            w, begun = begun, begun + 1
        if best + s < window:
            level[best + s].append(w)
            count[best + s] += 1
        out.append((w, best))
    return out, begun


def _pack(window: int):
    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, n = table.column("id").to_pylist(), table.column("n").to_pylist()
        full, rest = table.column("full").to_pylist(), table.column("rest").to_pylist()
        parts, order = table.column("parts").to_pylist(), table.column("by").to_numpy()
        row = table.column("row").to_numpy()
        rows = [r for r in np.lexsort((row, n, order)).tolist()]
        rests = [r for r in rows if n[r] % window]
        where, begun = place([n[r] % window for r in rests], window)
        fill = [0] * begun
        for r, (w, _) in zip(rests, where):
            fill[w] += n[r] % window
        out, loose = [], []
        for r, (w, offset) in zip(rests, where):
            size = n[r] % window
            if fill[w] == window:
                out.append((ids[r], n[r] - size, size, rest[r], n[r], w, offset))
            else:
                at = n[r] - size
                for p, crc in zip(_parts(size), parts[r]):
                    loose.append((-p, len(loose), ids[r], at, crc, n[r]))
                    at += p
        seq = begun
        for r in rows:
            for i, crc in enumerate(full[r]):
                out.append((ids[r], i * window, window, crc, n[r], seq, 0))
                seq += 1
        loose.sort(key=lambda x: x[:2])
        left, room, used = sum(-p for p, *_ in loose), 0, 0
        for p, _, doc, at, crc, size in loose:
            if used == room:                            # the next window, or at the end a power of two
                seq, used = seq + 1, 0
                room = window if left >= window else 1 << (left.bit_length() - 1)
                left -= room
            out.append((doc, at, -p, crc, size, seq, used))
            used -= p
        cols = list(zip(*out)) if out else [()] * 7
        cols[5] = [(shard << 32) + s for s in cols[5]]
        return pa.table([pa.array(c, pa.int64()) for c in cols],
                        names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None,
         window: int = 4096, end_id: int = 2, shard_ids: int = 32_000_000) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset)``.

    A document is its ids by the tokenizer file, then ``end_id``; every id lies
    in exactly one piece, pieces fill their sequences without gaps from offset
    0, and a sequence holds ``window`` ids (a power of two) or, at most
    ``log2(window)`` times in a shard, a smaller power of two. Shards hold
    about ``shard_ids`` ids, by a hash of the rows, and are packed on their own,
    so no task gets more than a shard.

    Null and empty texts are the end id alone; null ids stay null; repeated
    rows are packed each; other columns are not read; an empty table gives an
    empty one.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer or default_path()
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    cut = stored(source.mapInArrow(_cut(path, window, end_id), "id long, n long, full array<long>, rest long, "
                                                               "parts array<long>, row long"), "cut")
    total = cut.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_ids))
    # the row number tells copies of one row apart, so they do not meet in one shard
    dealt = cut.withColumn("by", F.xxhash64("id", "n", "rest", "row")).withColumn(
        "shard", F.expr(f"pmod(by, {shards})"))
    return dealt.groupBy("shard").applyInArrow(_pack(window), _PIECE)
