"""Spelling variants: words one edit apart, found by dynamic programming along
sorted lists.

A pair of words one edit apart first differs at some position. The positions
are cut into intervals, and for each interval the words that share all
characters before and after it form a block, so a word goes to four blocks and
near words always meet in exactly one that is theirs. Blocks beyond a size
bound are cut again at half the interval; in an interval of one position the
alphabet bounds a block.

Within a block the middles of the words are a sorted list, and every word is
compared with the words after it by the edit matrix, of which only the band of
three diagonals counts. Going down the list, a word keeps the matrix rows of
the prefix that it shares with the word before (their longest common prefix)
and computes the others; as soon as a row holds no value below two, all words
that share that prefix are skipped. All words of a task go down their lists at
once, a row of each at a time (numpy).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm._spark import keyed, prepare, stored, text_of

#: A block holds at most this many characters (words x length), if it can be cut.
BLOCK_CHARS = 1 << 20
_LETTERS = "A-Za-zÀ-ÿ"
_KEPT_WORDS = 400_000       # distinct words a task counts before it hands them on
_CELLS = 400_000            # characters of the lists that are worked on at once


def _counter(least: int, every: int):
    """Counts of words of at least ``least`` characters, summed over many texts."""
    runs = re.compile(f"[{_LETTERS}]{{{least},}}")      # a shorter run gives no word

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                own = Counter(map(bytes.lower, map(str.encode, runs.findall(text.as_py()))))   # bytes: only A-Z
                for run, n in own.items():
                    h = zlib.crc32(run, start)
                    if h % every == 0:
                        word = run.decode()
                        at = h % len(word)
                        if len(word) <= least:
                            continue
                        run = (word[:at] + word[at + 1:]).encode()
                    total[run] += n
                if len(total) > _KEPT_WORDS:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 7,
                least_n: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: the words of at least ``least_chars`` characters that
    occur at least ``least_n`` times in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased; of the runs whose crc32 ``h`` with the document's id (empty
    for null) is a multiple of ``every``, the character at ``h % length`` is
    left out. Null and empty texts have no words; rows that repeat count each.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                         text_of(text_col).alias("text"))
    counted = source.mapInArrow(_counter(least_chars, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# ---- blocks ---------------------------------------------------------------------

def _blocks(rows: DataFrame) -> DataFrame:
    """Rows ``(word, n, size, lo, hi)`` with the parts of the word: ``rest``, the
    ``lo`` characters before the interval and those after it, and ``mid``.
    ``size`` is the length of a pair's shorter word."""
    after = "greatest(size - hi, 0)"
    return rows.selectExpr(
        "n", "size", "lo", "hi",
        f"concat(substring(word, 1, lo), '|', substring(word, char_length(word) - {after} + 1)) as rest",
        f"substring(word, lo + 1, char_length(word) - lo - {after}) as mid")


def _first_blocks(words: DataFrame, least: int) -> DataFrame:
    """Each word as the shorter (or equal) and as the longer one of a pair, with
    the difference in the first and in the second half of the shorter one."""
    sized = words.selectExpr("word", "n", f"explode(filter(array(char_length(word), char_length(word) - 1), "
                                          f"x -> x >= {least})) as size")
    return _blocks(sized.selectExpr("word", "n", "size", "inline(array(struct(0 as lo, size div 2 as hi), "
                                                         "struct(size div 2 as lo, size + 1 as hi)))").selectExpr(
        "word", "n", "int(size) as size", "int(lo) as lo", "int(hi) as hi"))


def _halved(blocks: DataFrame) -> DataFrame:
    """Each block as two, by halves of its interval."""
    whole = "concat(substring(rest, 1, lo), mid, substring(rest, lo + 2)) as word"
    cut = blocks.selectExpr(whole, "n", "size", "inline(array(struct(lo as lo, (lo + hi) div 2 as hi), "
                                                "struct((lo + hi) div 2 as lo, hi as hi)))")
    return _blocks(cut.selectExpr("word", "n", "size", "int(lo) as lo", "int(hi) as hi"))


_KEY = ["size", "lo", "hi", "rest"]


def _bounded(blocks: DataFrame, limit: int) -> DataFrame:
    """The blocks, those of more than ``limit`` characters cut until none is left."""
    out = None
    while True:
        chars = F.sum(F.expr("char_length(mid) + 1"))
        large = stored(blocks.filter("hi - lo > 1").groupBy(*_KEY).agg(chars.alias("chars")).filter(
            F.col("chars") > limit).select(*_KEY), "large-blocks")
        n = large.count()
        small = blocks.join(keyed(large, n), _KEY, "left_anti") if n else blocks
        out = small if out is None else out.unionByName(small)
        if not n:
            return out
        blocks = stored(_halved(blocks.join(keyed(large, n), _KEY, "left_semi")), "half-blocks")


# ---- sorted lists ---------------------------------------------------------------

def _lists(chars: np.ndarray, length: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words sorted within blocks: the longest common prefix of each with the
    one before (-1 where a block begins), and, by prefix length, where the words
    that share a word's prefix end."""
    n, wide = chars.shape
    lcp = np.full(n, -1, np.int64)
    same = chars[1:] == chars[:-1]
    same[np.arange(wide)[None, :] >= np.minimum(length[1:], length[:-1])[:, None]] = False
    inside = block[1:] == block[:-1]
    lcp[1:][inside] = np.where(same.all(axis=1), wide, np.argmin(same, axis=1))[inside]
    ends = np.empty((wide + 1, n), np.int64)
    at = np.arange(n)
    for depth in range(wide + 1):
        cut = np.append(np.flatnonzero(lcp < depth), n)
        ends[depth] = cut[np.searchsorted(cut, at, "right")]
    return lcp, ends


def near_pairs(chars: np.ndarray, length: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, i < j, of words of one block that are exactly one edit
    apart. ``chars`` holds a word a row (0 after its end), sorted within blocks."""
    n, wide = chars.shape
    lcp, ends = _lists(chars, length, block)
    query = np.flatnonzero(ends[0] > np.arange(n) + 1)      # words with others after them
    at, stop = query + 1, ends[0][query]
    depth = lcp[at]
    padded = np.zeros((n, wide + 2), chars.dtype)
    padded[:, 1:-1] = chars
    # the rows kept of each word: (its length so far) x (diagonals -1, 0, 1); against itself 1, 0, 1
    rows = np.empty((len(query), wide + 1, 3), np.uint8)
    rows[:] = (1, 0, 1)
    rows[:, 0, 0] = 2
    left, right = [], []
    lane = np.arange(len(query))
    while len(lane):
        q, p, d = query[lane], at[lane], depth[lane]
        char, size = chars[p, d], length[q]
        low, mid, high = rows[lane, d].T
        new_low = np.minimum(low + (padded[q, d] != char), mid + 1)
        new_mid = np.minimum(np.minimum(mid + (padded[q, d + 1] != char), high + 1), new_low + 1)
        new_mid[d + 1 > size] = 2
        ahead = padded[q, np.minimum(d + 2, wide + 1)]
        new_high = np.minimum(high + (ahead != char), new_mid + 1)
        new_high[d + 2 > size] = 2
        new_low[d > size] = 2
        rows[lane, d + 1, 0], rows[lane, d + 1, 1], rows[lane, d + 1, 2] = new_low, new_mid, new_high
        alive = np.minimum(np.minimum(new_low, new_mid), new_high) < 2
        whole = alive & (d + 1 == length[p])
        apart = size - length[p]                             # the diagonal of the whole words
        value = np.where(apart == 0, new_mid, np.where(apart == 1, new_high, np.where(apart == -1, new_low, 2)))
        hit = whole & (value == 1)
        left.append(q[hit])
        right.append(p[hit])
        onward = alive & ~whole
        depth[lane[onward]] += 1
        moved = lane[~onward]                                # to the next word, or past all that share the prefix
        there = np.where(whole, p + 1, ends[d + 1, p])[~onward]
        at[moved] = there
        more = there < stop[moved]
        depth[moved[more]] = lcp[there[more]]
        lane = np.concatenate([lane[onward], moved[more]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """By word: its near words here, and of those the most frequent (of equal
    counts the first in code-point order)."""
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    met = np.unique(b)
    place = np.zeros(len(words), np.int64)
    place[sorted(met.tolist(), key=words.__getitem__)] = np.arange(len(met))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    word, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in word.tolist()], pa.string()), pa.array(count, pa.int64()), pa.array(n[best]),
         pa.array([words[i] for i in best.tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the blocks of a partition, which come one after another,
    each with its middles sorted."""
    held, cells = [], 0

    def work():
        table = pa.Table.from_batches(held)
        rest, mid = table.column("rest").to_pylist(), table.column("mid").to_pylist()
        n, size, lo, hi = (table.column(c).to_numpy() for c in ("n", "size", "lo", "hi"))
        new = np.ones(len(mid), bool)
        new[1:] = ((size[1:] != size[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
                   | np.fromiter((x != y for x, y in zip(rest[1:], rest)), bool, len(rest) - 1))
        block = np.cumsum(new) - 1
        keep = np.flatnonzero(np.bincount(block)[block] > 1)
        if not len(keep):
            return
        mids = [mid[i] for i in keep.tolist()]
        length = np.fromiter(map(len, mids), np.int64, len(mids))
        wide = int(length.max())
        if not wide:
            return
        chars = np.frombuffer("".join(m.ljust(wide, "\0") for m in mids).encode("utf-32-le"), "<u4").reshape(-1, wide)
        a, b = near_pairs(chars, length, block[keep])
        # a pair belongs to the block of its shorter length and of the position where it first differs
        same = chars[a] == chars[b]
        least = np.minimum(length[a], length[b])
        same[np.arange(wide)[None, :] >= least[:, None]] = False
        first = np.where(same.all(axis=1), wide, np.argmin(same, axis=1)) if len(a) else least
        size, lo, hi = size[keep], lo[keep], hi[keep]
        own = (least + lo[a] + np.maximum(size[a] - hi[a], 0) == size[a]) & (first < hi[a] - lo[a])
        a, b = a[own], b[own]
        if len(a):
            parts = [rest[i] for i in keep.tolist()]
            words = [r[:k] + m + r[k + 1:] for r, k, m in zip(parts, lo.tolist(), mids)]
            yield _best(words, n[keep], a, b)

    for batch in batches:
        done = 0
        keys = [batch.column(c) for c in ("size", "lo", "hi", "rest")]
        edge = np.zeros(len(batch), bool)               # a block begins here
        for c in keys:
            if len(batch) > 1:
                differ = pc.not_equal(c.slice(1), c.slice(0, len(batch) - 1))
                edge[1:] |= differ.to_numpy(zero_copy_only=False)
        if held and len(batch):
            edge[0] = any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("size", "lo", "hi", "rest"))
        wide = batch.column("span").to_numpy()
        count = np.cumsum(wide)
        for i in np.flatnonzero(edge).tolist():
            here = cells + int(count[i - 1] if i else 0) - int(count[done - 1] if done else 0)
            before = (wide[i - 1] if i > done else held[-1].column("span")[-1].as_py() if held else wide[i])
            if here >= _CELLS or wide[i] > 2 * before + 8:   # the lists are padded to the longest word
                if i > done:
                    held.append(batch.slice(done, i - done))
                yield from work()
                held, cells, done = [], 0, i
        if done < len(batch):
            held.append(batch.slice(done))
            cells += int(count[-1] - (count[done - 1] if done else 0))
    if held:
        yield from work()


def near_words(words: DataFrame, *, least_chars: int = 7, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, n, n_near, best, best_n)`` for distinct ``(word, n)``: how many
    of the words of at least ``least_chars`` characters are exactly one inserted,
    deleted or replaced character away, and which of these has the largest
    ``n`` (ties: the smallest in code-point order; null if there is none)."""
    prepare(words.sparkSession)
    rows = _bounded(_first_blocks(words, least_chars), block_chars)
    found = rows.withColumn("span", F.expr("char_length(mid)")).repartition(*_KEY).withColumn(
        "wide", F.expr("size - lo - greatest(size - hi, 0)")).sortWithinPartitions("wide", *_KEY, "mid").select(
        "rest", "mid", "n", "size", "lo", "hi", "span").mapInArrow(
        _scan, "word string, n_near long, best_n long, best string")
    own = words.selectExpr("word", "n", "0L as n_near", "cast(null as struct<rank: bigint, best: string>) as found")
    found = found.selectExpr("word", "cast(null as bigint) as n", "n_near", "struct(-best_n as rank, best) as found")
    return own.unionByName(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("found").alias("found")).selectExpr(
        "word", "n", "n_near", "found.best as best", "-found.rank as best_n")


def _with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word on the way of
    forms. Only words that are a form and have one need a search; a form is at
    least ``ratio`` times as frequent, so ways are short and each round doubles
    the steps taken."""
    links = forms.filter("form is not null").select("word", "form")
    inner = stored(links.join(links.select(F.col("form").alias("word")).distinct(), "word", "left_semi")
                   .withColumnRenamed("form", "root"), "inner-forms")
    n = inner.count()
    while n:
        step = inner.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(inner.join(keyed(step, n), "root", "left").selectExpr(
            "word", "coalesce(next, root) as root", "next is not null as moved"), "inner-forms")
        moved = longer.filter("moved").isEmpty()
        inner = longer.drop("moved")
        if moved:
            break
    last = inner.select(F.col("word").alias("form"), F.col("root").alias("last"))
    return forms.join(keyed(last, n), "form", "left").withColumn("root", F.expr("coalesce(last, form, word)")).drop("last")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 7,
                      least_n: int = 2, every: int = 31, ratio: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every word of ``word_counts`` with its form and root: ``(word, form, root,
    n, n_near, form_n)``.

    ``form`` is the near word (one character inserted, deleted or replaced) of
    the largest count, if that is at least ``ratio`` times the word's own, else
    null; ``root`` the word at the end of the way of forms, the word itself
    where it has none; ``n_near`` the number of near words. Null and empty texts
    add no words, repeated rows add theirs again, null ids count as empty text
    in the choice of left-out characters, other columns are not read, and an
    empty table gives no rows.
    """
    words = stored(word_counts(docs, id_col, text_col, least_chars=least_chars, least_n=least_n, every=every), "words")
    near = near_words(words, least_chars=least_chars, block_chars=block_chars)
    formed = f"best_n >= {ratio} * n"
    forms = stored(near.selectExpr("word", f"if({formed}, best, null) as form", "n", "n_near",
                                   f"if({formed}, best_n, null) as form_n"), "forms")
    return _with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
