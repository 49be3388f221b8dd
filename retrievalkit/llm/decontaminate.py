"""Benchmark passages inside documents: size-partitioned MinHash containment.

A test item of ``q`` shingles inside a document of thousands has a tiny Jaccard
similarity, so MinHash alone would need thousands of hashes. As in a
size-partitioned containment index, both sides are therefore cut by size: items
fall into classes of at most ``u`` shingles (powers of two), and for each class
a document is a row of overlapping windows of ``2 u`` shingles (or the whole
document, if that is shorter), so that every run of ``u`` shingles lies in some
window. In one class the containment threshold ``t`` becomes the Jaccard bound
``t q / (window + q - t q)``, and the number of hashes is the least that misses
a pair at that bound with probability ``miss`` or less. ``spread`` lowers the
bound further, for items whose shingles lie in several places.

A window that shares a minimum with an item makes the pair a candidate; every
candidate is verified by the exact share of the item's distinct shingles that
occur anywhere in the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm import _words as W
from retrievalkit.llm._spark import prepare, text_of

#: Words of items that one pass over the documents looks for. More items take
#: more passes, so the broadcast index stays below about 50 MB.
ITEM_WORDS = 500_000
_FILTER_BITS = 16
_HIGH = np.uint64(32)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _HIGH).astype(np.uint32)


class ItemIndex:
    """Shingle sets of the items of one pass and, by size class, their minima."""

    def __init__(self, texts: list[str], k: int, percent: int, miss: float, spread: float, lower: bool):
        self.k, self.percent, self.lower = k, percent, lower
        col = pa.array(texts, pa.string())
        self.sets: list[np.ndarray] = []
        self.windows: list[int] = []         # shingles of the item, repeats counted
        self.short: dict[int, dict[int, list[int]]] = {}   # words -> hash -> items
        for lo, _, buf, off in W.chunks(col):
            words = W.Words(buf, off)
            hashes = words.hashes(lower)
            sh, so = W.shingles(hashes, words.first, k)
            for i, (a, b) in enumerate(zip(so[:-1], so[1:])):
                n = int(words.count[i])
                self.sets.append(np.unique(sh[a:b]))
                self.windows.append(int(b - a) if n >= k else 0)
                if 0 < n < k:
                    at = words.first[i]
                    one = W.shingles(hashes[at:at + n], np.array([0, n]), n)[0][0]
                    self.short.setdefault(n, {}).setdefault(int(one), []).append(lo + i)
        t = percent / 100 * spread
        self.classes = []
        # very repetitive items would need very many hashes: their few shingles are looked up instead
        by_class: dict[int, list[int]] = {}
        looked_up: dict[int, list[int]] = {}
        for i, w in enumerate(self.windows):
            u = 1 << max(3, (w - 1).bit_length())
            if w and 8 * len(self.sets[i]) >= u:
                by_class.setdefault(u, []).append(i)
            elif w:
                for x in self.sets[i].tolist():
                    looked_up.setdefault(x, []).append(i)
        self.looked_up = looked_up
        self.wanted = np.array(sorted(looked_up), np.uint64)
        for u, items in sorted(by_class.items()):
            q = min(len(self.sets[i]) for i in items)
            bound = t * q / (2 * u + q - t * q)
            m = math.ceil(math.log(miss) / math.log(1 - bound))
            mul = (W.mix(np.arange(1, m + 1, dtype=np.uint64)) >> _HIGH).astype(np.uint32) | np.uint32(1)
            mins = np.array([[(_short(self.sets[i]) * c).min() for i in items] for c in mul], np.uint32)
            order = np.argsort(mins, axis=1, kind="stable")
            filt = np.zeros((m, 1 << _FILTER_BITS), bool)
            for h in range(m):
                filt[h, mins[h] >> np.uint32(32 - _FILTER_BITS)] = True
            self.classes.append((u, mul, np.take_along_axis(mins, order, 1), np.array(items)[order], filt))

    def candidates(self, sh: np.ndarray, so: np.ndarray) -> set[tuple[int, int]]:
        """``(text, item)`` pairs of which a window shares a minimum."""
        found: set[tuple[int, int]] = set()
        if len(self.wanted):
            for pos in np.flatnonzero(np.isin(sh, self.wanted)):
                d = int(np.searchsorted(so, pos, "right")) - 1
                found.update((d, i) for i in self.looked_up[int(sh[pos])])
        if not self.classes or not len(sh):
            return found
        small = self.classes[0][0]
        size = np.diff(so)
        blocks = -(-size // small)                       # blocks of the smallest class
        where = np.repeat(np.arange(len(size)), blocks)
        at = so[:-1][where] + (np.arange(len(where)) - (np.cumsum(blocks) - blocks)[where]) * small
        # column = block; a text's last block repeats its last shingle
        grid = _short(sh)[np.minimum(at + np.arange(small)[:, None], so[1:][where] - 1)]
        levels, width = [], small                        # how blocks merge from class to class
        for u, _, mins, items, filt in self.classes:
            merges = []
            while width < u:
                count = np.bincount(where, minlength=len(size))
                rank = np.arange(len(where)) - (np.cumsum(count) - count)[where]
                pick = np.flatnonzero(rank % 2 == 0)
                merges.append((pick, np.where(rank[pick] + 1 < count[where[pick]], pick + 1, pick)))
                where, width = where[pick], 2 * width
            levels.append((mins, items, filt, merges, where, where[1:] != where[:-1]))
        longest = max(self.classes, key=lambda c: len(c[1]))[1]
        for h, mul in enumerate(longest):
            low = (grid * mul).min(axis=0)
            for mins, items, filt, merges, where, last in levels:
                for one, other in merges:
                    low = np.minimum(low[one], low[other])
                if h >= len(mins):
                    continue
                window = low.copy()                      # a block and the next of its text
                np.minimum(window[:-1], low[1:], out=window[:-1])
                window[:-1][last] = low[:-1][last]
                hit = np.flatnonzero(filt[h][window >> np.uint32(32 - _FILTER_BITS)])
                if not len(hit):
                    continue
                lo = np.searchsorted(mins[h], window[hit], "left")
                hi = np.searchsorted(mins[h], window[hit], "right")
                for j in np.flatnonzero(hi > lo):
                    d = int(where[hit[j]])
                    found.update((d, int(i)) for i in items[h][lo[j]:hi[j]])
        return found

    def search(self, column) -> Iterator[tuple[int, int, int]]:
        """``(row, item, shared)`` of every verified pair of a text column."""
        for first, _, buf, off in W.chunks(column):
            words = W.Words(buf, off)
            hashes = words.hashes(self.lower)
            sh, so = W.shingles(hashes, words.first, self.k)
            for d, i in sorted(self.candidates(sh, so)):
                mine = np.unique(sh[so[d]:so[d + 1]])
                item = self.sets[i]
                at = np.searchsorted(mine, item)
                at[at == len(mine)] = 0
                shared = int((mine[at] == item).sum())
                if 100 * shared >= self.percent * len(item):
                    yield first + d, i, shared
            for n, known in sorted(self.short.items()):  # items of fewer than k words: the whole sequence
                sh, so = W.shingles(hashes, words.first, n)
                sh[so[:-1][(words.count > 0) & (words.count < n)]] = 0
                want = np.fromiter(known, np.uint64, len(known))
                for pos in np.flatnonzero(np.isin(sh, want)):
                    d = int(np.searchsorted(so, pos, "right")) - 1
                    if (sh[so[d]:pos] != sh[pos]).all():
                        for i in known[int(sh[pos])]:
                            yield first + d, i, 1


def _passes(items: DataFrame, item_id: str, item_text: str, build) -> Iterator[tuple[list, object]]:
    """``(ids, broadcast index)`` of each pass over the documents."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), text_of(item_text).alias("text"))
    words = rows.select(F.sum(F.size(F.split("text", r"[\x09-\x0D\x20]+"))).alias("n")).first()["n"] or 0
    n = -(-words // ITEM_WORDS)
    part = F.expr(f"pmod(xxhash64(text), {max(n, 1)})")
    for p in range(n):
        mine = rows.filter(part == p).orderBy("id", "text").collect()
        yield [r["id"] for r in mine], items.sparkSession.sparkContext.broadcast(build([r["text"] for r in mine]))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", *, k: int = 5, percent: int = 80,
                    miss: float = 1e-4, spread: float = 0.5, lower: bool = True) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` of every document row
    and item of which at least ``percent`` in 100 of the distinct ``k``-word
    shingles occur in the document (A-Z lower-cased if ``lower``).

    An item of fewer than ``k`` words matches where its whole word sequence
    occurs. Items and documents without words, or null, match nothing. Repeated
    rows on either side are reported each; null ids stay null. Other columns
    are not read. Empty tables give an empty one. Documents are not shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, index in _passes(items, item_id, item_text,
                              lambda t: ItemIndex(t, k, percent, miss, spread, lower)):
        def find(batches: Iterator[pa.RecordBatch], ids=ids, index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(index.value.search(batch.column(1)))
                size = [len(index.value.sets[i]) for _, i, _ in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([r for r, _, _ in rows], pa.int64())),
                    pa.array([ids[i] for _, i, _ in rows], pa.int64()), pa.array(size, pa.int64()),
                    pa.array([s for _, _, s in rows], pa.int64()),
                    pa.array([s / n for (_, _, s), n in zip(rows, size)], pa.float64())],
                    names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        out = out.unionByName(source.mapInArrow(find, schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text",
                   item_id: str = "item_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item (see ``contained_items``), with all
    their columns, filtered where they are."""
    how = {"k": 5, "percent": 80, "miss": 1e-4, "spread": 0.5, "lower": True} | how
    prepare(docs.sparkSession)
    out, at = docs, docs.columns.index(text_col)
    for _, index in _passes(items, item_id, item_text, lambda t: ItemIndex(t, **how)):
        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                ok[[r for r, _, _ in index.value.search(batch.column(at).fill_null(""))]] = False
                yield batch.filter(pa.array(ok))

        out = out.mapInArrow(keep, docs.schema)
    return out
