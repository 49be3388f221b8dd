"""Training-row construction.

Random choices rank by ``md5(seed:salt:query_id:doc_id[:copy])``. "One per
query" is a ``min(struct(key, doc))`` aggregate and "n per query" a
``row_number() <= n`` filter, which Catalyst turns into a partial
``WindowGroupLimit`` before the shuffle: a query with millions of candidates
never travels whole to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.functions.keys import sample_key
from retrievalkit.functions.text import with_prefix
from retrievalkit.operators.sampling import select_split
from retrievalkit.tables import RagTables


def choose_positive(tables: RagTables, split: str | None = None, seed: int = 42) -> DataFrame:
    """One random relevant document per query of the split; queries
    without one are skipped. -> ``(query_id, doc_id)``"""
    qs = select_split(tables, split).select("query_id")
    pos = tables.positives().join(qs, "query_id", "left_semi")
    best = pos.groupBy("query_id").agg(
        F.min(F.struct(sample_key(seed, "pos", "query_id", "doc_id").alias("k"),
                       F.col("doc_id"))).alias("m"))
    return best.select("query_id", "m.doc_id")


def sample_negatives(tables: RagTables, n: int, split: str | None = None,
                     seed: int = 42) -> DataFrame:
    """``n`` negatives per query -> ``(query_id, slot, doc_id)``.

    m >= n: n distinct ones. m < n: the list is repeated ceil(n/m) times and
    n copies are drawn without replacement, so an id occurs at most
    ceil(n/m) times. m = 0: the query is skipped (see T6).
    """
    qs = select_split(tables, split).select("query_id")
    neg = tables.negatives().join(qs, "query_id", "left_semi").dropDuplicates()
    # 1) the n smallest copy-1 keys per query: a partial WindowGroupLimit runs
    #    before the shuffle, so a query with millions of negatives sends <= n
    #    rows per task; a query with m < n negatives keeps all of them here.
    k1 = sample_key(seed, "neg", "query_id", "doc_id", F.lit(1))
    w1 = Window.partitionBy("query_id").orderBy(k1, F.col("doc_id"))
    top = neg.withColumn("r1", F.row_number().over(w1)).where(F.col("r1") <= n).drop("r1")
    # 2) m per query is an aggregate (map-side combine), joined to <= n rows.
    m = neg.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    copies = (top.join(m, "query_id")
              .withColumn("copy", F.explode(F.sequence(
                  F.lit(1), F.greatest(F.lit(1), F.ceil(F.lit(float(n)) / F.col("m")).cast("int"))))))
    key = sample_key(seed, "neg", "query_id", "doc_id", "copy")
    w = Window.partitionBy("query_id").orderBy(key, F.col("doc_id"), F.col("copy"))
    return (copies.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
            .select("query_id", (F.col("rn") - 1).alias("slot"), "doc_id"))


def training_rows(tables: RagTables, split: str | None = None, negative_num: int = 0,
                  query_instruction: str | None = None,
                  passage_instruction: str | None = None, seed: int = 42):
    """Wide rows ``query_id, query, pos, neg_0 .. neg_{n-1}`` and the
    column list ``["query", "pos", "neg_0", ...]``.

    ``query`` is always set (with the query instruction when given).
    """
    qs = select_split(tables, split).select("query_id", "text")
    texts = tables.corpus.select("doc_id", with_prefix("text", passage_instruction).alias("t"))
    pos = choose_positive(tables, split, seed).join(texts, "doc_id").select(
        "query_id", F.col("t").alias("pos"))
    rows = qs.select("query_id", with_prefix("text", query_instruction).alias("query")).join(
        pos, "query_id")
    cols = ["query", "pos"] + [f"neg_{i}" for i in range(negative_num)]
    if negative_num > 0:
        negs = (sample_negatives(tables, negative_num, split, seed).join(texts, "doc_id")
                .groupBy("query_id").pivot("slot", list(range(negative_num)))
                .agg(F.first("t")))
        negs = negs.select("query_id", *[F.col(str(i)).alias(f"neg_{i}")
                                         for i in range(negative_num)])
        rows = rows.join(negs, "query_id")
    return rows.select("query_id", *cols), cols


def training_pairs(tables: RagTables, split: str | None = None,
                   query_instruction: str | None = None,
                   passage_instruction: str | None = None, seed: int = 42):
    """T4: (anchor, positive) rows = T3 without negatives."""
    return training_rows(tables, split, 0, query_instruction, passage_instruction, seed)


def scored_pairs(run: DataFrame, tables: RagTables) -> DataFrame:
    """T5: ``(sentence_A, sentence_B, score)`` for distillation from a run. No
    side of the joins is broadcast: a run's size is not known to the planner."""
    q = tables.queries.select("query_id", F.col("text").alias("sentence_A"))
    d = tables.corpus.select("doc_id", F.col("text").alias("sentence_B"))
    return run.join(q.hint("merge"), "query_id").join(d.hint("merge"), "doc_id").select(
        "query_id", "doc_id", "sentence_A", "sentence_B", "score")


def skipped_queries(tables: RagTables, split: str | None = None,
                    negative_num: int = 0) -> DataFrame:
    """Queries T3 leaves out, with reason ``no_positive`` or
    ``no_negative`` (the latter only when negatives are asked for)."""
    qs = select_split(tables, split).select("query_id")
    has_pos = tables.positives().select("query_id").distinct()
    no_pos = qs.join(has_pos, "query_id", "left_anti").select(
        "query_id", F.lit("no_positive").alias("reason"))
    if negative_num <= 0:
        return no_pos
    has_neg = tables.negatives().select("query_id").distinct()
    no_neg = (qs.join(has_pos, "query_id", "left_semi").join(has_neg, "query_id", "left_anti")
              .select("query_id", F.lit("no_negative").alias("reason")))
    return no_pos.unionByName(no_neg)
