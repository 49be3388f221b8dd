"""Numbering, splits, sampling and selection.

Randomness is a ranking by ``md5(seed:salt:id)`` (see functions.keys):
exact sizes, repeatable, independent of partitioning. An exact share of the rows
is drawn by finding the last key that belongs to it (``first_keys``): rows are
counted by key prefix, pass after pass, and then filtered; they are not sorted
or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.functions.keys import sample_key
from retrievalkit.session import ensure_checkpoint_dir
from retrievalkit.tables import RagTables

_POS_BITS = 33
_DIGITS = 4                  # hex digits of a key per pass: at most 65,536 counts
_LEAF = 10_000               # keys of one prefix that may be put in order to find the last one


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dense_index(df: DataFrame, order_cols, out: str = "ord", partition_cols=(),
                num_partitions: int | None = None) -> DataFrame:
    """0-based dense position by ``order_cols`` (within ``partition_cols``).

    No single-task global window: rows are range-partitioned on the order,
    each row gets (partition, position) from ``monotonically_increasing_id``
    after a per-partition sort, the result is checkpointed (the sampled range
    bounds must not change on recomputation), and per-partition counts - one
    small row per (partition, group) - give prefix offsets.

    The order must be total (append a unique id as last order column).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    pcols = list(partition_cols)
    okeys = [f"__di_o{i}" for i in range(len(order_cols))]
    src = df.select("*", *[c.alias(k) for c, k in zip(_cols(order_cols), okeys)])
    sort = [*pcols, *okeys]
    # The range bounds are sampled in one pass and the shuffle reads the input
    # in another: cache it so the upstream plan runs once.
    src = src.persist(StorageLevel.MEMORY_AND_DISK)
    # Without an explicit count AQE may coalesce adjacent ranges (order kept);
    # positions are taken after that, so they stay consistent.
    ranged = (src.repartitionByRange(num_partitions, *sort) if num_partitions
              else src.repartitionByRange(*sort))
    keyed = (ranged.sortWithinPartitions(*sort)
             .withColumn("__di_mid", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    src.unpersist()
    pid = F.shiftright("__di_mid", _POS_BITS).alias("__di_pid")
    pos = F.col("__di_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    keyed = keyed.withColumn("__di_pid", pid).withColumn("__di_pos", pos)
    counts = keyed.groupBy("__di_pid", *pcols).agg(F.count(F.lit(1)).alias("__di_cnt"),
                                               F.min("__di_pos").alias("__di_first"))
    w = (Window.partitionBy(*pcols).orderBy("__di_pid")
         .rowsBetween(Window.unboundedPreceding, -1)) if pcols else (
        Window.orderBy("__di_pid").rowsBetween(Window.unboundedPreceding, -1))
    # one row per (partition, group): the window over it is tiny
    offsets = counts.withColumn("__di_off", F.coalesce(F.sum("__di_cnt").over(w), F.lit(0)))
    offsets = offsets.select("__di_pid", *pcols, "__di_off", "__di_first")
    if not pcols:   # one row per range partition: a proven size bound
        offsets = F.broadcast(offsets)
    res = keyed.join(offsets, ["__di_pid", *pcols])
    res = res.withColumn(out, (F.col("__di_off") + F.col("__di_pos") - F.col("__di_first")).cast("long"))
    return res.drop("__di_mid", "__di_pid", "__di_pos", "__di_off", "__di_first", "__di_cnt", *okeys)


def first_keys(df: DataFrame, key: Column, id_col: str, size: Callable[[int], int]) -> Column:
    """A condition that holds for the first ``size(n)`` of the ``n`` rows of
    ``df`` in the order (md5 ``key``, id), to be used on ``df``.

    Each pass counts the rows by the next digits of the key, within the prefix
    where the wanted size is passed, until a prefix fits whole or has at most
    ``_LEAF`` rows; a pass shuffles and returns at most 65,536 counts. Rows
    without an id are not counted and not drawn; rows that share an id are drawn
    together, so the size is exact for unique ids.
    """
    ids = F.col(id_col).cast("string")
    keyed = df.select(key.alias("k"), ids.alias("i")).where("i is not null")
    prefix, left = "", None                      # rows still wanted of those with the prefix
    while True:
        some = keyed.where(F.substring("k", 1, len(prefix)) == prefix) if prefix else keyed
        counts = sorted(some.groupBy(F.substring("k", len(prefix) + 1, _DIGITS).alias("p")).agg(
            F.count(F.lit(1)).alias("c")).collect())
        if left is None:
            n = sum(c for _, c in counts)
            left = size(n)
            if left <= 0:
                return F.lit(False)
            if left >= n:
                return ids.isNotNull()
        for p, c in counts:
            if left <= c:
                break
            left -= c
        prefix += p
        if left == c or len(prefix) == 32:
            return ids.isNotNull() & (F.substring(key, 1, len(prefix)) <= prefix)
        if c <= _LEAF:
            last = (keyed.where(F.substring("k", 1, len(prefix)) == prefix).orderBy("k", "i").limit(left)
                    .agg(F.max(F.struct("k", "i")).alias("m")).first()["m"])
            return (key < last["k"]) | ((key == last["k"]) & (ids <= last["i"]))


def select_split(tables: RagTables, split: str | None = None) -> DataFrame:
    """``None`` -> all queries; else that split's queries, ``ord`` = list
    position. An unknown split raises (checked with a one-row probe)."""
    if split is None:
        return tables.queries
    ids = tables.splits.where(F.col("split") == split)
    if not ids.limit(1).collect():
        raise KeyError(f"unknown split: {split}")
    return (ids.select("query_id", "ord").join(tables.queries.drop("ord"), "query_id")
            .select("query_id", "text", "ord"))


def split_train_val(queries: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Splits table with exactly ``int(n * ratio)`` validation queries,
    drawn without replacement; both lists keep dataset order (``ord`` =
    position in the list). The seed is always applied."""
    if not 0 <= ratio <= 1:
        raise ValueError(f"validation share {ratio} is outside [0, 1]")
    drawn = first_keys(queries, sample_key(seed, "split", "query_id"), "query_id", lambda n: int(n * ratio))
    labelled = queries.withColumn("split", F.when(drawn, "val").otherwise("train"))
    out = dense_index(labelled.select("query_id", "split", "ord"),
                      [F.col("ord"), F.col("query_id")], out="pos", partition_cols=["split"])
    return out.select("query_id", "split", F.col("pos").alias("ord"))


def split_dev(splits: DataFrame, frac: float = 0.5, seed: int = 42) -> DataFrame:
    """Train -> train + dev (dev size ``ceil(n * frac)``), val -> test."""
    train = splits.where("split = 'train'")
    drawn = first_keys(train, sample_key(seed, "dev", "query_id"), "query_id", lambda n: math.ceil(n * frac))
    parts = train.select("query_id", "ord", F.when(drawn, "dev").otherwise("train").alias("split"))
    rest = (splits.where("split <> 'train'")
            .withColumn("split", F.when(F.col("split") == "val", "test").otherwise(F.col("split"))))
    return parts.select("query_id", "split", "ord").unionByName(rest.select("query_id", "split", "ord"))


def sample_docs(corpus: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """U4: k documents without replacement; k larger than the corpus raises.
    Every column is kept, and no document is shuffled."""
    def size(n: int) -> int:
        if k > n:
            raise ValueError(f"sample larger than population: {k} > {n}")
        return k

    return corpus.where(first_keys(corpus, sample_key(seed, "sample", id_col), id_col, size))


def subset_corpus(tables: RagTables, first_n: int) -> RagTables:
    """Keep the first n documents by order, drop relevant ids outside,
    drop queries left with none. Split positions stay those of the unfiltered
    lists."""
    corpus = tables.corpus.where(F.col("ord") < first_n)
    qrels = tables.qrels.join(corpus.select("doc_id"), "doc_id", "left_semi")
    live = qrels.where("relevance = 1").select("query_id").distinct()
    return tables.with_(
        corpus=corpus,
        qrels=qrels.join(live, "query_id", "left_semi").select("query_id", "doc_id", "relevance"),
        queries=tables.queries.join(live, "query_id", "left_semi"),
        splits=tables.splits.join(live, "query_id", "left_semi"),
        answers=tables.answers.join(live, "query_id", "left_semi"),
    )


def judged_pool(tables: RagTables, split: str | None = None) -> DataFrame:
    """Corpus restricted to documents judged (relevant or negative) for
    the evaluated queries."""
    qs = select_split(tables, split).select("query_id")
    judged = tables.qrels.join(qs, "query_id", "left_semi").select("doc_id").distinct()
    return tables.corpus.join(judged, "doc_id", "left_semi")
