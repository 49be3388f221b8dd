"""Exact substring join: which texts contain which patterns.

Every text is read once. Of its windows of ``w`` bytes those are kept whose
64-bit fingerprint is the smallest of some ``g`` windows in a row. The choice
depends on those bytes alone, so the windows a pattern of ``w + g - 1`` bytes or
more keeps are kept in every text that contains it; shorter patterns have
classes of smaller ``w`` and ``g``, the shortest that of their own length. A
pattern is then looked up by the one of its windows that the fewest texts hold,
and what is found so is compared in full.

Texts hand on only windows that some pattern has, by a list of the patterns'
fingerprints as long as these are at most ``LISTED`` (16 MB); beyond that all
kept windows go to a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.session import materialised, ship_package

LISTED = 2_000_000
#: (least bytes of a pattern, window, windows in a row); shorter patterns are a class by length
CLASSES = ((47, 16, 32), (12, 8, 5))
_CHUNK = 1 << 20
_KEPT = "row long, class int, print long"


def class_of(size: int) -> tuple[int, int]:
    """Window and run of a pattern of ``size`` bytes."""
    return next(((w, g) for least, w, g in CLASSES if size >= least), (size, 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def prints(data: np.ndarray, w: int) -> np.ndarray:
    """A fingerprint of every window of ``w`` bytes (at most 16)."""
    n = len(data) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word, size = data.astype(np.uint64), 1
    while size * 2 <= min(w, 8):                 # bytes read as ever longer little-endian numbers
        word = word[:-size] | (word[size:] << np.uint64(8 * size))
        size *= 2
    # the first and the last ``size`` bytes of a window tell all of it
    out = _mix(word[:n] + np.uint64(w))
    if size < w:
        out ^= _mix(word[w - size:w - size + n]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def kept(values: np.ndarray, g: int) -> np.ndarray:
    """Places that hold the smallest value of some ``g`` in a row."""
    if g == 1 or len(values) < g:
        return np.arange(len(values) if g == 1 else 0)

    def runs(x: np.ndarray, of) -> np.ndarray:
        size = 1
        while size * 2 <= g:
            x = of(x[:-size], x[size:])
            size *= 2
        return of(x[:len(x) - (g - size)], x[g - size:]) if size < g else x

    least = runs(values, np.minimum)             # of the run that begins here
    around = np.full(len(least) + 2 * (g - 1), 0, np.uint64)
    around[g - 1:g - 1 + len(least)] = least
    return np.flatnonzero(runs(around, np.maximum) == values)


def _windows(classes: list[tuple[int, int]], listed):
    """The kept windows of each text, once each: all, or those in ``listed``
    (sorted fingerprints by class)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value if listed is not None else None

        def work(rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(texts), np.uint8)
            end = np.cumsum([len(t) for t in texts])
            out = []
            for c, (w, g) in enumerate(classes):
                values = prints(data, w)
                place = np.arange(len(values))
                text = np.searchsorted(end, place, "right")
                across = place + w > end[text]       # of two texts: the least of all, so no run with one keeps another
                values[across] = 0
                if known is not None and g == 1:
                    at = np.flatnonzero(_in(known[c], values))
                else:
                    at = kept(values, g)
                    if known is not None:
                        at = at[_in(known[c], values[at])]
                at = at[~across[at]]
                text = text[at]
                one = np.unique(np.stack([text.astype(np.uint64), values[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                out.append((np.array(rows, np.int64)[one[0].astype(np.int64)], np.full(one.shape[1], c, np.int32), one[1].view(np.int64)))
            row, c, value = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(c), pa.array(value)], names=["row", "class", "print"])

        rows, texts, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append(row)
                texts.append(data)
                size += len(data)
                if size >= _CHUNK:
                    yield work(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield work(rows, texts)

    return run


def _in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def contains_pairs(patterns: DataFrame, texts: DataFrame, *, p_id: str = "id", p_text: str = "text",
                   t_id: str = "id", t_text: str = "text", listed: int = LISTED) -> DataFrame:
    """``(pattern_id, text_id)`` for every text that contains a pattern, once
    each. Null texts contain nothing, a null pattern is in nothing, an empty one
    in every text that is not null; repeated rows and ids add no rows. Other
    columns are not read."""
    spark = texts.sparkSession
    ship_package(spark)
    # equal patterns are searched once
    asked = materialised(patterns.select(F.col(p_id).alias("pattern_id"), F.col(p_text).alias("p")).where(
        "p is not null").distinct(), "patterns")
    source = texts.select(F.col(t_id).alias("text_id"), F.col(t_text).alias("t")).where("t is not null")
    empty = asked.where("p = ''").select("pattern_id")
    found = _empty_pairs(empty, source)
    sizes = [r["n"] for r in asked.where("p <> ''").select(F.least(F.octet_length("p"), F.lit(CLASSES[0][0])).alias(
        "n")).distinct().collect()]              # at most 47 rows
    classes = sorted({class_of(n) for n in sizes})
    if not classes:
        return found
    number = F.create_map(*[F.lit(x) for n in sizes for x in (n, classes.index(class_of(n)))])
    distinct = materialised(asked.where("p <> ''").select("p", number[F.least(
        F.octet_length("p"), F.lit(CLASSES[0][0]))].alias("class")).distinct().withColumn(
            "row", F.monotonically_increasing_id()), "distinct-patterns")
    binary = lambda df, c: df.select("row", F.encode(c, "UTF-8").alias("text"))
    own = materialised(binary(distinct, "p").mapInArrow(_windows(classes, None), _KEPT).join(
        distinct.select("row", "class"), ["row", "class"]).select("row", "class", "print"), "pattern-windows")
    n = own.select("class", "print").distinct().count()
    handle = None
    if n <= listed:
        by_class: list[list[int]] = [[] for _ in classes]
        for r in own.select("class", "print").distinct().collect():
            by_class[r["class"]].append(r["print"])
        handle = spark.sparkContext.broadcast([np.sort(np.array(x, np.int64).view(np.uint64)) for x in by_class])
    # a text is known by its id and hash, so rows that share an id stay apart
    keyed = source.withColumn("row", F.xxhash64(F.col("text_id").cast("string"), "t"))
    held = binary(keyed, "t").mapInArrow(_windows(classes, handle), _KEPT)
    if handle is None:
        held = held.join(own.select("class", "print").distinct(), ["class", "print"], "left_semi")
    held = materialised(held.distinct(), "text-windows")
    counts = held.groupBy("class", "print").agg(F.count("*").alias("texts"))
    rarest = own.join(counts, ["class", "print"], "left").withColumn("texts", F.coalesce("texts", F.lit(0))).groupBy("row").agg(
        F.min(F.struct("texts", "class", "print")).alias("best")).where("best.texts > 0").select(
        F.col("row").alias("pattern"), "best.class", "best.print")
    pairs = materialised(held.join(rarest, ["class", "print"]).select("pattern", "row").distinct(), "contains-candidates")
    # the texts and patterns themselves, for the comparison in full
    some = pairs.select("row").distinct()
    long = keyed.join(some, "row", "left_semi").select("row", "text_id", "t")
    compared = pairs.join(long, "row").join(distinct.select(F.col("row").alias("pattern"), "p"), "pattern").where(
        F.contains("t", "p")).select("p", "text_id").distinct()
    return found.unionByName(asked.join(compared, "p").select("pattern_id", "text_id").distinct())


def _empty_pairs(empty: DataFrame, source: DataFrame) -> DataFrame:
    """Every text for every empty pattern, if there are any."""
    ids = [r["pattern_id"] for r in empty.distinct().limit(1).collect()]
    every = source.select("text_id").distinct()
    if not ids:
        kind = dict(empty.dtypes)["pattern_id"]
        return every.limit(0).select(F.lit(None).cast(kind).alias("pattern_id"), "text_id")
    tagged = empty.distinct().withColumn("k", F.lit(1))
    return every.withColumn("k", F.lit(1)).join(tagged, "k").select("pattern_id", "text_id")


__all__ = ["contains_pairs", "prints", "kept", "class_of", "CLASSES", "LISTED"]
