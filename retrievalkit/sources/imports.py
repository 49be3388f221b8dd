"""Dataset imports (D4, D5) and dataset-level reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.operators.sampling import dense_index
from retrievalkit.session import materialised
from retrievalkit.tables import RagTables


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def import_judged(spark: SparkSession, corpus: DataFrame, queries: DataFrame,
                  judged: DataFrame, order_col: str) -> RagTables:
    """Corpus ``(id, text)``, queries ``(id, text)`` and judgments
    ``(qid, docid, relevance)``.

    Relevance 1 -> relevant, 0 -> negative, anything else fails the job.
    Pairs are deduplicated per role (a pair judged both ways stays in both).
    A repeated corpus/query id keeps the **last** text at its **first**
    position (dict assignment); ``order_col`` of corpus and queries gives the
    input order and must differ between rows of one id.
    """
    def last_wins(df: DataFrame, out_id: str) -> DataFrame:
        agg = (df.select(F.col("id").cast("string").alias("id"), "text", F.col(order_col).alias("_o"))
               .groupBy("id")
               .agg(F.min("_o").alias("_first"), F.max_by("text", "_o").alias("text")))
        ranked = dense_index(agg, [F.col("_first"), F.col("id")])
        return ranked.select(F.col("id").alias(out_id), "text", "ord")

    checked = judged.select(
        F.col("qid").cast("string").alias("query_id"),
        F.col("docid").cast("string").alias("doc_id"),
        F.when(F.col("relevance").isin(0, 1), F.col("relevance").cast("int")).otherwise(
            F.raise_error(F.concat(F.lit("relevance must be 0 or 1, found "),
                                   F.coalesce(F.col("relevance").cast("string"), F.lit("null"))))).alias("relevance"))
    qrels = checked.dropDuplicates(["query_id", "doc_id", "relevance"])
    return RagTables.create(
        spark,
        corpus=last_wins(corpus, "doc_id"),
        queries=last_wins(queries, "query_id"),
        qrels=qrels)


def import_triples(spark: SparkSession, triples: DataFrame) -> RagTables:
    """Rows ``(query, positive, negative, ord)``, ``ord`` any orderable value.

    The first row of each query text wins; later rows with the same query are
    dropped whole (their documents are not added). Documents are deduplicated
    by exact text over both roles. Ids ``q-N`` / ``c-N`` number first
    appearances; inside a row the positive comes before the negative.

    Numbering and the joins from texts to ids carry 256-bit hashes; texts are
    joined back once, by ``ord``. A kept row whose positive or negative is null
    gives no query, judgments or documents. "First row per query" is a ``min(struct(ord, ...))`` aggregate, so a hot
    query text is combined map-side instead of landing in one window task.
    """
    kept = (triples.groupBy("query")
            .agg(F.min(F.struct("ord", "positive", "negative")).alias("m"))
            .select("query", "m.ord", "m.positive", "m.negative"))
    kept = materialised(kept, "triples")         # numbering, queries and corpus read it
    key = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    slim = kept.where("positive is not null and negative is not null").select(
        "ord", key("positive").alias("hp"), key("negative").alias("hn"))
    q = dense_index(slim, [F.col("ord")], out="n").select(
        F.concat(F.lit("q-"), F.col("n").cast("string")).alias("query_id"), "n", "ord", "hp", "hn")
    queries = q.select("query_id", "ord", "n").join(kept.select("ord", "query"), "ord").select(
        "query_id", F.col("query").alias("text"), F.col("n").alias("ord"))
    # a document's place is its first row, and in it the positive before the negative
    place = lambda h, side: slim.select(F.col(h).alias("h"), F.struct("ord", F.lit(side).alias("side")).alias("p"))
    first = place("hp", 0).unionByName(place("hn", 1)).groupBy("h").agg(F.min("p").alias("p"))
    ids = dense_index(first, [F.col("p")], out="n").select(
        F.concat(F.lit("c-"), F.col("n").cast("string")).alias("doc_id"), "n", "h", "p")
    corpus = ids.select("doc_id", "n", "p.ord", "p.side").join(kept.select("ord", "positive", "negative"), "ord").select(
        "doc_id", F.when(F.col("side") == 0, F.col("positive")).otherwise(F.col("negative")).alias("text"),
        F.col("n").alias("ord"))
    pair = q.select("query_id", F.explode(F.array(
        F.struct(F.col("hp").alias("h"), F.lit(1).alias("relevance")),
        F.struct(F.col("hn").alias("h"), F.lit(0).alias("relevance")))).alias("j")).select("query_id", "j.h", "j.relevance")
    qrels = pair.join(ids.select("h", "doc_id"), "h").select("query_id", "doc_id", "relevance")
    return RagTables.create(spark, queries=queries, corpus=corpus, qrels=qrels)


def dataset_summary(tables: RagTables) -> DataFrame:
    """One row ``(corpus, train_queries, val_queries)`` from a single
    aggregate over the tagged union (no join of one-row results)."""
    tagged = (tables.corpus.select(F.lit("corpus").alias("t"))
              .unionByName(tables.splits.select(F.col("split").alias("t"))))
    return tagged.agg(
        F.count_if(F.col("t") == "corpus").alias("corpus"),
        F.count_if(F.col("t") == "train").alias("train_queries"),
        F.count_if(F.col("t") == "val").alias("val_queries"))


def check_integrity(tables: RagTables) -> DataFrame:
    """Report ``(check, id)`` of every dangling reference: split ids not
    in queries, relevant / negative ids not in the corpus, judged queries
    that do not exist."""
    q = tables.queries.select("query_id")
    c = tables.corpus.select("doc_id")
    parts = [
        tables.splits.select("query_id").join(q, "query_id", "left_anti")
        .select(F.lit("split_query_missing").alias("check"), F.col("query_id").alias("id")),
        tables.qrels.where("relevance = 1").join(c, "doc_id", "left_anti")
        .select(F.lit("relevant_doc_missing").alias("check"), F.col("doc_id").alias("id")),
        tables.qrels.where("relevance = 0").join(c, "doc_id", "left_anti")
        .select(F.lit("negative_doc_missing").alias("check"), F.col("doc_id").alias("id")),
        tables.qrels.select("query_id").join(q, "query_id", "left_anti")
        .select(F.lit("judged_query_missing").alias("check"), F.col("query_id").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def assert_integrity(tables: RagTables) -> None:
    """Strict mode: raise like the reference's KeyError on the first problem."""
    bad = check_integrity(tables).limit(1).collect()
    if bad:
        raise KeyError(f"{bad[0]['check']}: {bad[0]['id']}")
