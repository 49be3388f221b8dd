"""Exact token-length histogram and its suffix sums.

Documents are aggregated by encoded length in one pass; all questions about
totals, quantiles and truncation at any context limit are then answered from
the histogram, whose size is the number of distinct lengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare, stored, text_of
from retrievalkit.llm.tokens import default_path, word_tokens


def length_histogram(docs: DataFrame, text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """``(n_tokens, n_docs)`` for every length that occurs, special tokens not
    counted.

    Null and empty texts have length 0; repeated rows count each; other columns
    are not read; an empty table gives an empty histogram.
    """
    prepare(docs.sparkSession)
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_tokens(path).counts(batch.column(0)))], names=["n_tokens"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "n_tokens long").groupBy("n_tokens").agg(
        F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length, as a context limit: documents and tokens at or above it and
    at or below it, the tokens left if every document were cut there, and the
    share of documents that fit.

    Lengths fall into at most 64 blocks a power of two; sums run inside blocks,
    and the few block totals are added on top, so no task sorts the whole
    histogram. Rows with a null length or count take no part; an empty
    histogram gives no rows.
    """
    histogram = stored(histogram.dropna(subset=["n_tokens", "n_docs"]), "histogram")     # read twice below
    bits = F.length(F.bin("n_tokens"))
    block = bits * 64 + F.expr("(n_tokens >> greatest(length(bin(n_tokens)) - 7, 0)) & 63")
    rows = histogram.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("block").orderBy("n_tokens")
    # a few thousand rows at most: one per block
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(w), zero).alias(f"{c}_{n}")
                                      for n, w in (("above", above), ("below", below), ("all", every)) for c in ("d", "t")])
    down = inside.rowsBetween(0, Window.unboundedFollowing)
    up = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("block", "n_tokens", "n_docs",
                      *[F.sum(c).over(w).alias(f"{c}_{n}") for n, w in (("down", down), ("up", up))
                        for c in ("n_docs", "tokens")]).join(F.broadcast(blocks), "block")
    col = F.col
    return out.select(
        "n_tokens", "n_docs",
        (col("n_docs_down") + col("d_above")).alias("docs_at_least"),
        (col("tokens_down") + col("t_above")).alias("tokens_at_least"),
        (col("n_docs_up") + col("d_below")).alias("docs_at_most"),
        (col("tokens_up") + col("t_below")).alias("tokens_at_most"),
        (col("tokens_up") + col("t_below") + col("n_tokens") * (col("d_all") - col("n_docs_up") - col("d_below"))
         ).alias("truncated_tokens"),
        ((col("n_docs_up") + col("d_below")) / col("d_all")).alias("share_that_fits"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Any context limits: documents that fit, tokens left after truncation and
    tokens lost, one row per limit."""
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    kept = F.least("n_tokens", "limit") * F.col("n_docs")
    return histogram.select("n_tokens", "n_docs", each).groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_that_fit"),
        F.sum(kept).alias("truncated_tokens"), F.sum(F.col("n_tokens") * F.col("n_docs") - kept).alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The least length that so large a share of documents fits, per share."""
    each = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return sums.select("n_tokens", "share_that_fits", each).filter("share_that_fits >= share").groupBy("share").agg(
        F.min("n_tokens").alias("n_tokens"))
