"""Quality rules on repetition: a suffix array over the words of each text.

The suffix arrays of all texts of a chunk are built together by prefix
doubling; the first key holds the text, so no match crosses texts. The ranks of
every doubling level give the longest common prefix of neighbours in the array.
A suffix whose neighbour shares ``min_repeat`` words or more starts a maximal
repeated substring of that length; the union of these spans is the covered part
of the text, and the longest common prefix its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm import _words as W
from retrievalkit.llm._spark import prepare, text_of

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def repeats(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring of its text that
    starts there and occurs at another position of that text as well.

    ``keys``: a number per word; ``first``: offsets of the texts.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][text]
    key = W.mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        one, after = rank[tied], tied + h
        two = np.where(after < stop[tied], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((two, one))
        a, b = one[by], two[by]
        at = np.arange(len(by))
        group = np.ones(len(by), bool)
        group[1:] = a[1:] != a[:-1]
        sub = group.copy()
        sub[1:] |= b[1:] != b[:-1]
        rank = rank.copy()
        rank[tied[by]] = a + np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        h *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    pair = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])
    i, j = suffix[pair], suffix[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, x, y = levels[level], i + common, j + common
        ok = (x < stop[i]) & (y < stop[j])
        same = ok & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        common += np.where(same, 1 << level, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def covered(length: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which positions lie in the union of the repeated spans of ``least`` words
    or more (of each, its first ``width`` words)."""
    at = np.arange(len(length))
    reach = np.where(length >= least, at + (length if width is None else width), 0)
    return np.maximum.accumulate(reach) > at if len(length) else np.zeros(0, bool)


def _line_repeats(words: W.Words) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line."""
    n, texts = len(words.buf), len(words.off) - 1
    cut = np.zeros(n + 1, bool)
    breaks = np.flatnonzero(words.buf == 10)
    cut[breaks + 1] = True
    cut[words.off] = True
    begin = np.flatnonzero(cut[:n])
    if not len(begin):
        return np.zeros(texts, np.int64)
    end = np.append(begin[1:], n)
    end = end - (words.buf[end - 1] == 10)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[filled], end[filled]
    text = np.searchsorted(words.off, begin, "right") - 1
    key = W.mix(words.span_hashes(begin, end, False) + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, once = np.unique(key, return_index=True)
    return np.bincount(text, minlength=texts) - np.bincount(text[once], minlength=texts)


_OUT = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "covered_words long, covered_chars long, longest_repeat long, spans array<struct<start:long,end:long>>")


def _measure(min_repeat: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.chunks(batch.column(1)):
                words = W.Words(buf, off)
                length = repeats(words.hashes(False), words.first)
                part = covered(length, min_repeat)
                point = ((buf & 0xC0) != 0x80) & ~W.SPACE[buf]
                points = np.append(0, np.cumsum(point))
                edge = np.diff(np.concatenate(([False], part, [False])).astype(np.int8))
                # a span that ends where the next text's begins would run into it
                begin = np.union1d(np.flatnonzero(edge == 1), words.first[:-1][words.count > 0][
                    part[words.first[:-1][words.count > 0]]])
                text = np.searchsorted(words.first, begin, "right") - 1
                end = np.searchsorted(np.flatnonzero(edge == -1), begin, "right")
                end = np.minimum(np.flatnonzero(edge == -1)[end], words.first[1:][text]) if len(begin) else begin
                base = words.first[:-1][text]
                sums = lambda v: pa.array(W.run_sums(v.astype(np.int64), words.first))
                chars = lambda v: pa.array(W.run_sums(v.astype(np.int64), off))
                spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], fields=list(span))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), chars(point),
                    chars(_SYMBOL[buf]), pa.array(_line_repeats(words)), sums(covered(length, 3, 3)), sums(part),
                    sums((points[words.end] - points[words.start]) * part),
                    pa.array(-W.run_mins(-length, words.first, 0)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()), spans),
                ], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "covered_words", "covered_chars", "longest_repeat", "spans"])

    return measure


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                       min_repeat: int = 8, max_covered_percent: int = 50, max_longest: int = 250,
                       min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: word and line counts, the repeated part of
    the text and the verdict.

    ``covered_words``: words in the union of maximal repeated substrings of
    ``min_repeat`` words or more; ``covered_chars``: their code points; ``spans``: that union as word offsets (end
    exclusive); ``longest_repeat``: words of the longest repeated substring.
    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` in 100 words in 3-word windows that occur twice.
    ``kept``: not so, covered fraction within ``max_covered_percent``, of the words
    and of their code points, and longest repeat within ``max_longest``. (All covered
    words are in windows that occur twice, so at equal limits the base rules alone
    hold the fraction of the words; that of the code points they do not.)

    Words are case-sensitive. Null and blank texts have no words and fail the
    base rules; null ids are returned as they are; repeated rows are judged
    each; other columns are not read; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    failed = f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"
    return source.mapInArrow(_measure(min_repeat), _OUT).withColumn("base_failed", F.expr(failed)).withColumn(
        "kept", F.expr(f"not base_failed and 100 * covered_words <= {max_covered_percent} * n_words "
                       f"and 100 * covered_chars <= {max_covered_percent} * word_chars and longest_repeat <= {max_longest}"))
