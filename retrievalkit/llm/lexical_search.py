"""Ranked lexical search: the best documents for each item, by branch and bound
over document FP-trees.

Documents are read once and kept as their length and their counts of the items'
terms. Each task then builds FP-trees over the documents it holds: a document's
terms are put in order of frequency, most frequent first, and documents share
the path of the terms they begin with. A node knows, over the documents below
it, the largest count of each term and the smallest ``m`` (the length part of
the score), so the score of any of them is at most that of these together. Each
item goes down the tree depth first, best child first, and leaves out every
subtree that cannot reach its k-th best score so far, which it carries from
tree to tree. What a task finds is at most k documents an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.llm import _words as W
from retrievalkit.llm._spark import prepare, stored, text_of

#: Bytes that are in no term: all of ASCII but digits and letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VECTOR = "id long, n long, terms array<int>, counts array<int>"
_TOP = np.iinfo(np.int64).max


# ---- terms of the documents -----------------------------------------------------

class Vocabulary:
    """The items' terms, numbered in order of their 64-bit hash."""

    def __init__(self, terms: list[str]):
        buf, off = W.utf8(pa.array(terms, pa.string()))
        words = W.Words(buf, off, BETWEEN)
        hashes = words.hashes(True)
        order = np.argsort(hashes)
        self.terms = [terms[i] for i in order.tolist()]
        self.hash, self.size = hashes[order], (words.end - words.start)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hash >> np.uint64(44)] = True

    def find(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """The words of a chunk that are terms of the vocabulary, and which."""
        hashes = words.hashes(True)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        which = np.searchsorted(self.hash, hashes[some])
        which[which == len(self.hash)] = 0
        ok = (self.hash[which] == hashes[some]) & (self.size[which] == (words.end - words.start)[some])
        return some[ok], which[ok]


def _vectors(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handle.value
        for batch in batches:
            for lo, hi, buf, off in W.chunks(batch.column("text")):
                words = W.Words(buf, off, BETWEEN)
                at, term = known.find(words)
                doc = np.searchsorted(words.first, at, "right") - 1
                key, count = np.unique(doc * len(known.terms) + term, return_counts=True)
                doc, term = np.divmod(key, len(known.terms))
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(words.count),
                     pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))], names=["id", "n", "terms", "counts"])

    return run


def _holders(size: int):
    """How many documents hold each term, of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    return run


# ---- the tree -------------------------------------------------------------------

class Tree:
    """An FP-tree over one or more documents, given as CSR (``ends``; ``term``, ``count`` with
    term numbers in order of frequency, rising within a document).

    Nodes are numbered so that the children of a node stand together, and the
    last level of every path are the documents themselves. For each (term,
    node), in this order, ``most`` holds the largest count below the node."""

    def __init__(self, ends: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray, ids: np.ndarray,
                 leaf: int = 16, deep: int = 256):
        n = len(m)
        data, size = term.astype(">u4").tobytes(), np.diff(ends)
        paths = [data[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = np.array(sorted(range(n), key=lambda i: (paths[i], ids[i])), np.int64)
        # terms shared by neighbours; beyond ``deep`` of them neighbours only stand in order
        wide = int(min(deep, size.max(initial=0)))
        head = np.full((n, wide + 1), -1, np.int32)
        inside = np.arange(wide)[None, :] < size[order][:, None]
        head[:, :wide][inside] = term[(ends[:-1][order][:, None] + np.arange(wide))[inside]]
        differ = head[1:] != head[:-1]
        shared = np.where(differ.any(axis=1), np.argmax(differ, axis=1), wide)
        # nodes by level: (first, end) places of documents, and where the children begin
        level, number = [(0, n)], 0
        parents, nodes = [-1], []
        self.children: list[tuple[int, int]] = []
        while level:
            below, owners = [], []
            start = number + len(level)
            for k, (a, b) in enumerate(level):
                begin = start + len(below)
                if b - a > leaf:
                    lcp = shared[a:b - 1]
                    cuts = [a, *(np.flatnonzero(lcp == lcp.min()) + a + 1).tolist(), b]
                    at = a
                    for x, y in zip(cuts[:-1], cuts[1:]):      # small children that follow one another are one
                        if y - x > leaf or y - at > leaf:
                            if at < x:
                                below.append((at, x))
                            at = x
                            if y - x > leaf:
                                below.append((x, y))
                                at = y
                    if at < b:
                        below.append((at, b))
                elif b - a > 1 or number + k == 0:
                    below += [(i, i + 1) for i in range(a, b)]
                owners += [number + k] * (start + len(below) - begin)
                self.children.append((begin, start + len(below)))
            nodes += level
            parents += owners
            number, level = start, below
        spans, parent = np.array(nodes, np.int64), np.array(parents, np.int64)
        self.nodes = len(spans)
        final = np.array([a == b for a, b in self.children])
        self.doc = np.where(final, order[np.minimum(spans[:, 0], n - 1)], -1)
        by_place, id_by_place = m[order], ids[order]
        self.m, self.least_id = by_place[spans[:, 0]], id_by_place[spans[:, 0]]
        for v in np.flatnonzero(~final).tolist():
            a, b = nodes[v]
            self.m[v], self.least_id[v] = by_place[a:b].min(), id_by_place[a:b].min()
        # largest counts, from the documents up
        leaf_of = np.empty(n, np.int64)
        leaves = np.flatnonzero(self.doc >= 0)
        leaf_of[self.doc[leaves]] = leaves
        at, key, most = np.repeat(leaf_of, size), term.astype(np.int64), count.astype(np.int64)
        keys, counts = [key * self.nodes + at], [most]
        while len(at):
            up = parent[at]
            if (up < 0).all():
                break
            # paths differ in length, so a node may get a term several times; the largest is taken in the end
            ok = up >= 0
            joined = key[ok] * self.nodes + up[ok]
            place = np.argsort(joined, kind="stable")
            joined, value = joined[place], most[ok][place]
            begin = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
            joined, most = joined[begin], np.maximum.reduceat(value, begin)
            key, at = np.divmod(joined, self.nodes)
            keys.append(joined)
            counts.append(most)
        key, most = np.concatenate(keys), np.concatenate(counts)
        place = np.argsort(key, kind="stable")
        key, most = key[place], most[place]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.key = key[begin]
        self.most = np.maximum.reduceat(most, begin) if len(key) else most

    def below(self, node: int, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each child of a node the largest score that a document below it
        may have; for a document its score."""
        a, b = self.children[node]
        ends = np.searchsorted(self.key, np.concatenate([terms * self.nodes + a, terms * self.nodes + b]))
        begin, size = ends[:len(terms)], ends[len(terms):] - ends[:len(terms)]
        total = int(size.sum())
        shift = np.cumsum(size) - size
        at = np.repeat(begin - shift, size) + np.arange(total)
        child = self.key[at] - np.repeat(terms * self.nodes, size)
        tf = self.most[at]
        score = np.repeat(weight, size) * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[child]))
        out = np.zeros(b - a, np.int64)
        np.add.at(out, child - a, score)
        return out


@dataclass
class Best:
    """The k best documents of an item so far: score, id (largest for null), null."""

    k: int
    score: np.ndarray
    id: np.ndarray
    null: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def wants(self, score: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether documents of at most this score and at least this id may enter."""
        if len(self.score) < self.k:
            return score > 0
        return (score > self.score[-1]) | ((score == self.score[-1]) & (least_id <= self.id[-1]))

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        null = np.concatenate([self.null, null])
        order = np.lexsort((null, ids, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def search(tree: Tree, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound of one item; how many nodes were opened."""
    stack, opened = [(_TOP, -_TOP, 0)], 0
    while stack:
        bound, least, node = stack.pop()
        if not best.wants(np.array([bound]), np.array([least]))[0]:
            continue
        opened += 1
        a, b = tree.children[node]
        score = tree.below(node, terms, weight)
        some = np.flatnonzero(best.wants(score, tree.least_id[a:b]) & (score > 0))
        doc = tree.doc[a + some]
        final = doc >= 0
        if final.any():
            best.add(score[some[final]], ids[doc[final]], null[doc[final]])
        for i in some[~final][np.argsort(score[some[~final]], kind="stable")].tolist():
            stack.append((int(score[i]), int(tree.least_id[a + i]), a + i))
    return opened


def _searcher(handle, k: int, total: int, length: int, postings: int):
    """Trees of about ``postings`` entries at most over a task's documents, each gone
    through for every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, items = handle.value                      # term number -> place in order of frequency
        best = [Best.none(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def work() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            key, counts, terms = (table.column(c).chunk(0) for c in ("id", "counts", "terms"))
            size = pc.list_value_length(terms).to_numpy()
            term, count = place[terms.flatten().to_numpy()], counts.flatten().to_numpy()
            order = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
            null = key.is_null().to_numpy(zero_copy_only=False)
            ids = key.fill_null(_TOP).to_numpy()
            m = 25 + 75 * table.column("n").to_numpy() * total // length
            tree = Tree(np.append(0, np.cumsum(size)), term[order], count[order], m, ids)
            for (_, own, weight), found in zip(items, best):
                search(tree, ids, null, own, weight, found)

        size = 0
        for batch in batches:
            lo = 0
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy() + 32)   # and room for a path
            while lo < len(batch):
                room = postings - size + (int(ends[lo - 1]) if lo else 0)
                hi = max(lo + 1, int(np.searchsorted(ends, room, "right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - (int(ends[lo - 1]) if lo else 0)
                if size >= postings or hi < len(batch):
                    work()
                    held, size = [], 0
                lo = hi
        if held:
            work()
        for (nr, *_), found in zip(items, best):
            if len(found.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nr] * len(found.score), pa.int64()), pa.array(found.id, mask=found.null), pa.array(found.score)],
                    names=["nr", "id", "score"])

    return run


# ---- the operator ---------------------------------------------------------------

def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(nr, id, terms, times)``: each distinct item with its distinct terms."""
    one = items.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).distinct().select(
        "id", F.translate("text", _UPPER, _LOWER).alias("text"))
    found = one.withColumn("all", F.regexp_extract_all("text", F.lit(f"({_PATTERN})"), F.lit(1))).withColumn(
        "terms", F.array_distinct("all"))
    return stored(found.select(F.monotonically_increasing_id().alias("nr"), "id", "all", "terms"), "items").filter(
        "size(terms) > 0")


def _blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in blocks of at most ``most`` terms, or of one item with more."""
    n, parts = items.count(), 1
    while True:
        part = F.expr(f"pmod(xxhash64(nr), {parts})")
        sizes = items.groupBy(part.alias("part")).agg(F.sum(F.size("all")).alias("terms")).agg(F.max("terms")).first()[0] or 0
        if sizes <= most or parts > 8 * n:
            return [items.filter(part == b) for b in range(parts)] if n else []
        parts *= 2


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", *, block_terms: int = 1_000_000,
                  postings: int = 1_000_000) -> DataFrame:
    """The ``k`` best documents of each item: ``(item_id, rank, id, score)``,
    rank 1 first, equal scores by ascending id (null last).

    Terms are the maximal runs of ASCII digits and letters and of characters
    beyond ASCII, with A-Z lower-cased. Of ``N`` documents with a term that have
    ``L`` terms in all, one with ``n`` terms has ``m = 25 + 75 n N div L``; a
    term held by ``df`` of them weighs ``w = floor(1000 ln((2 N + 2) / (2 df +
    1)))``; a document's score is the sum of ``w (10^9 tf div (1000 tf + 8 m))``
    over the item's terms, repeats included. Documents of score 0 are left out.

    Null and empty texts have no terms: such documents are not counted, such
    items have no rows. Every row of ``docs`` is a document, also one that
    repeats another; rows of ``items`` that repeat id and text are one item, and
    rows that share only the id are each ranked. Other columns are not read.

    Terms are matched by a 64-bit hash and their length. The items go in blocks
    of at most ``block_terms`` terms, whose vocabulary is broadcast (an item
    with more is a block of its own); documents are read once a block.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    known = _item_terms(items, item_id, item_text)
    out = spark.createDataFrame([], "nr long, id long, score long")
    for block in _blocks(known, block_terms):
        rows = block.select("nr", "all").collect()
        if not rows:
            continue
        vocabulary = Vocabulary(sorted({t for r in rows for t in r["all"]}))
        handle = spark.sparkContext.broadcast(vocabulary)
        vectors = stored(source.mapInArrow(_vectors(handle), _VECTOR), "term-vectors")
        total, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not total:
            continue
        size = len(vocabulary.terms)
        df = np.zeros(size, np.int64)
        for r in vectors.select("terms").mapInArrow(_holders(size), "term int, df long").groupBy("term").agg(
                F.sum("df").alias("df")).collect():      # at most a row for each term of the block
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        place = np.empty(size, np.int64)
        place[np.lexsort((np.arange(size), -df))] = np.arange(size)
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        queries = []
        for r in rows:
            own, times = np.unique([number[t] for t in r["all"]], return_counts=True)
            queries.append((r["nr"], place[own], weight[own] * times))
        search_handle = spark.sparkContext.broadcast((place, queries))
        out = out.unionByName(vectors.filter("size(terms) > 0").mapInArrow(
            _searcher(search_handle, k, total, length, postings), "nr long, id long, score long"))
    order = Window.partitionBy("nr").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(known.select("nr", F.col("id").alias("item_id")), "nr").select("item_id", "rank", "id", "score")
