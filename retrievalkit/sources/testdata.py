"""Retrieval datasets derived from the driver's tables (FIXTURES.md).

Every derivation is a join / filter / aggregate over the *whole* table, so the
work grows with the data.

* vectors: ``embeddings`` -> ``(id, vec, label)``; used leave-one-out (every
  vector queries all others; relevant = same label).
* conversation pairs: a user turn directly followed by an assistant turn is a
  (query, positive) pair; the negative is the answer of the next pair of the
  same conversation, wrapping to its first pair.
* judgments: ``labels`` as relevance of documents to the query
  ``lang-source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id string, vec array<float>, label int)`` from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"),
                    F.col("embedding").alias("vec"), "label")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query, positive, negative, ord, conv_id, turn)``.

    Equi-joins only: (conv_id, turn) -> (conv_id, turn + 1) for the answer,
    (conv_id, turn + 2) for the next pair, and the conversation's first pair
    (a per-conversation ``min``) when there is no next one.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive"))
    pairs = u.join(a, ["conv_id", "turn"])
    nxt = pairs.select("conv_id", (F.col("turn") - 2).alias("turn"),
                       F.col("positive").alias("next_pos"))
    first_turn = pairs.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    first = pairs.join(first_turn, ["conv_id", "turn"]).select(
        "conv_id", F.col("positive").alias("first_pos"))
    return (pairs.join(nxt, ["conv_id", "turn"], "left").join(first, "conv_id", "left")
            .select("query", "positive",
                    F.coalesce("next_pos", "first_pos").alias("negative"),
                    F.struct("conv_id", "turn").alias("ord"),
                    "conv_id", "turn"))


def judgments(spark: SparkSession, sf_dir: str):
    """corpus ``(id, text, o)``, queries ``(id, text, o)``, judgments
    ``(qid, docid, relevance)`` from documents + labels, ``o`` = input order.

    Documents come by descending id; those labelled toxic come again later with
    another text. Every document brings its query ``lang-source`` with a text
    of its own. Labels are judgments twice over, and toxic documents are judged
    the other way as well.
    """
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    toxic = lab.where("toxic = 1").select("doc_id")
    again = d.join(toxic, "doc_id", "left_semi")
    corpus = d.select(F.col("doc_id").cast("string").alias("id"), "text", (-F.col("doc_id")).alias("o")).unionByName(
        again.select(F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit(" (second version)")).alias("text"),
                     (F.col("doc_id") + 1).alias("o")))
    qid = F.concat_ws("-", "lang", "source")
    queries = d.select(qid.alias("id"), F.concat(qid, F.lit(" as of "), F.col("doc_id").cast("string")).alias("text"),
                       F.col("doc_id").alias("o"))
    judged = (lab.join(d.select("doc_id", "lang", "source"), "doc_id")
              .select(qid.alias("qid"), F.col("doc_id").cast("string").alias("docid"),
                      F.explode(F.when(F.col("toxic") == 1, F.array("quality", "quality", 1 - F.col("quality")))
                                .otherwise(F.array("quality", "quality"))).alias("relevance"))
              .select("qid", "docid", F.col("relevance").cast("int").alias("relevance")))
    return corpus, queries, judged


def qa_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a model response per document id = conv_id: the conversation's
    (question, answer) pairs as a JSON array inside a markdown json fence. Of
    every seven, one breaks off, one is an object instead of an array, and one
    has no fence. One group per conversation (bounded by its turns)."""
    from retrievalkit.operators.synth import ANSWER_KEY, QUESTION_KEY

    p = conversation_pairs(spark, sf_dir)
    arr = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.struct(
            F.col("query").alias(QUESTION_KEY), F.col("positive").alias(ANSWER_KEY)).alias("qa")))),
        lambda s: s["qa"])
    return (p.groupBy("conv_id").agg(arr.alias("qa"))
            .select(F.col("conv_id").cast("string").alias("corpus_id"),
                    F.sha2(F.col("conv_id").cast("string"), 256).alias("prompt_key"),
                    F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("```json\n"), F.expr(
                        "substring(to_json(qa), 1, length(to_json(qa)) - 5)"), F.lit("\n```")))
                    .when(F.col("conv_id") % 7 == 4, F.concat(F.lit("```json\n"), F.to_json(F.struct("qa")), F.lit("\n```")))
                    .when(F.col("conv_id") % 7 == 5, F.to_json("qa"))
                    .otherwise(F.concat(F.lit("```json\n"), F.to_json("qa"), F.lit("\n```"))).alias("response")))


def passages(spark: SparkSession, sf_dir: str):
    """every ``benchmark`` text as a query over all ``documents``; a document
    is relevant if it contains the query's text."""
    from retrievalkit.operators.substring_join import contains_pairs
    from retrievalkit.session import materialised
    from retrievalkit.tables import RagTables

    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    found = contains_pairs(b, d, p_id="item_id", t_id="doc_id")
    qrels = materialised(found.select(F.col("pattern_id").cast("string").alias("query_id"),
                                      F.col("text_id").cast("string").alias("doc_id"), F.lit(1).alias("relevance")), "qrels")
    return RagTables.create(
        spark, qrels=qrels,
        queries=b.select(F.col("item_id").cast("string").alias("query_id"), "text", F.col("item_id").alias("ord")),
        corpus=d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("ord")))
