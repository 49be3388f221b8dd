"""Persistent forms: native Parquet store (D3), run store (D7), response
store (Q6) and the one-object dataset JSON at the interop edge (D1, D2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrievalkit import tables as S
from retrievalkit.session import path_exists
from retrievalkit.tables import RagTables

# ---- D3: native store --------------------------------------------------------


def save_tables(tables: RagTables, path: str, mode: str = "overwrite") -> None:
    """All tables at once: their jobs share the executors instead of waiting for each other."""
    _at_once(tables.queries.sparkSession, [lambda name=name, df=df: df.write.mode(mode).parquet(f"{path}/{name}") for name, df in tables.items()])


def _at_once(spark: SparkSession, writes) -> None:
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
            done.result()


def load_tables(spark: SparkSession, path: str) -> RagTables:
    return RagTables.create(spark, **{
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in S.TABLE_SCHEMAS.items()})


# ---- D7: runs ------------------------------------------------------------------


def write_run(run: DataFrame, path: str, overwrite: bool = False) -> None:
    """Partitioned by run_id; without ``overwrite`` an existing path fails."""
    (run.select(*S.RUN.fieldNames()).write.partitionBy("run_id")
     .mode("overwrite" if overwrite else "errorifexists").parquet(path))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.RUN).parquet(path).select(*S.RUN.fieldNames())


# ---- Q6: model responses ----------------------------------------------------------

RESPONSES = T.StructType([
    T.StructField("corpus_id", T.StringType(), False),
    T.StructField("prompt_key", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
])


def save_responses(responses: DataFrame, path: str, mode: str = "append") -> None:
    """JSON Lines, one response per line (appendable, re-parseable)."""
    responses.select(*RESPONSES.fieldNames()).write.mode(mode).json(path)


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).json(path)


# ---- D1 / D2: dataset JSON, one record per line ------------------------------------

# The six top-level keys of the dataset JSON; each is a folder of
# JSON lines here, written and read in parallel.
LINES = {
    "queries": "id string, text string, ord long",
    "corpus": "id string, text string, ord long",
    "relevant_docs": "id string, doc_id string",
    "negative_docs": "id string, doc_id string",
    "reference_answers": "id string, text string",
    "queries_split": "split string, id string, ord long",
}


def write_rag_lines(tables: RagTables, path: str, mode: str = "errorifexists") -> None:
    """The dataset as JSON lines, one folder per key; a key's list is one
    line per member, so no value grows with the data."""
    q, d = F.col("query_id").alias("id"), F.col("doc_id").alias("id")
    parts = {
        "queries": tables.queries.select(q, "text", "ord"),
        "corpus": tables.corpus.select(d, "text", "ord"),
        "relevant_docs": tables.positives().select(q, "doc_id"),
        "negative_docs": tables.negatives().select(q, "doc_id"),
        "reference_answers": tables.answers.select(q, F.col("answer").alias("text")),
        "queries_split": tables.splits.select("split", q, "ord"),
    }
    _at_once(tables.queries.sparkSession, [lambda key=key, df=df: df.write.mode(mode).json(f"{path}/{key}") for key, df in parts.items()])


def read_rag_lines(spark: SparkSession, path: str) -> RagTables:
    """The dataset of ``write_rag_lines``; an absent key gives an empty
    table. Every folder is splittable by line."""
    def part(key: str) -> DataFrame:
        if not path_exists(spark, f"{path}/{key}"):
            return spark.createDataFrame([], LINES[key])
        return spark.read.schema(LINES[key]).option("mode", "FAILFAST").json(f"{path}/{key}")

    q = F.col("id").alias("query_id")
    judged = [part(key).select(q, "doc_id", F.lit(rel).alias("relevance"))
              for key, rel in (("relevant_docs", 1), ("negative_docs", 0))]
    return RagTables.create(
        spark, queries=part("queries").select(q, "text", "ord"),
        corpus=part("corpus").select(F.col("id").alias("doc_id"), "text", "ord"),
        qrels=judged[0].unionByName(judged[1]),
        answers=part("reference_answers").select(q, F.col("text").alias("answer")),
        splits=part("queries_split").select(q, "split", "ord"))


# ---- interop: dataset JSON as one object ------------------------------------------------

# The keys of the interchange format.
RAG_JSON = T.StructType([
    T.StructField("queries", T.MapType(T.StringType(), T.StringType())),
    T.StructField("corpus", T.MapType(T.StringType(), T.StringType())),
    T.StructField("relevant_docs", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("negative_docs", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("reference_answers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("queries_split", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
RAG_KEYS = RAG_JSON.fieldNames()


def read_rag_json(spark: SparkSession, path: str) -> RagTables:
    """The reference's one-object dataset JSON -> long tables.

    Interop edge only: one JSON object is one record and so one task; the
    native, splittable form is D3. Map order is kept as ``ord``; a missing
    key gives an empty table; an unknown top-level key fails the job.
    """
    raw = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    allowed = F.array(*[F.lit(k) for k in RAG_KEYS])
    unknown = F.array_except(keys, allowed)
    obj = (raw.select(
        F.when(F.size(unknown) == 0, F.from_json("value", RAG_JSON)).otherwise(
            F.raise_error(F.concat(F.lit("unexpected keyword argument(s): "),
                                   F.array_join(unknown, ", ")))).alias("o"))
        .select("o.*"))

    def ordered(col, k, v):
        return obj.select(F.posexplode(F.map_entries(col)).alias("ord", "e")).select(
            F.col("e.key").alias(k), F.col("e.value").alias(v), F.col("ord").cast("long"))

    queries = ordered("queries", "query_id", "text")
    corpus = ordered("corpus", "doc_id", "text")

    def lists(col, rel):
        return (obj.select(F.explode(col).alias("query_id", "ids"))
                .select("query_id", F.explode("ids").alias("doc_id"))
                .select("query_id", "doc_id", F.lit(rel).alias("relevance")))

    qrels = lists("relevant_docs", 1).unionByName(lists("negative_docs", 0))
    answers = obj.select(F.explode("reference_answers").alias("query_id", "answer"))
    splits = (obj.select(F.explode("queries_split").alias("split", "ids"))
              .select("split", F.posexplode("ids").alias("ord", "query_id"))
              .select("query_id", "split", F.col("ord").cast("long")))
    return RagTables.create(spark, queries=queries, corpus=corpus, qrels=qrels,
                            answers=answers, splits=splits)


def to_rag_json(tables: RagTables) -> DataFrame:
    """D2 as a DataFrame: one row, one column ``json`` holding the dataset
    object (non-ASCII kept raw). Map entries of queries / corpus / splits are
    ordered by ``ord``; relevant and negative id lists are sorted.

    One aggregate over a tagged union (no joins): the object is one value by
    the nature of the format, so this is interop for datasets that fit in one
    row; D3 is the scalable store.
    """
    arr = T.ArrayType(T.StringType())

    def rows(df, tag, k, v=None, a=None, ord_col=None):
        return df.select(F.lit(tag).alias("t"),
                         (F.col(ord_col) if ord_col else F.lit(None)).cast("long").alias("o"),
                         F.col(k).alias("k"),
                         (F.col(v) if v else F.lit(None)).cast("string").alias("v"),
                         (F.col(a) if a else F.lit(None)).cast(arr).alias("a"))

    def lists(df, key, item, tag, by_ord=False):
        elem = F.struct("ord", item) if by_ord else F.col(item)
        g = df.groupBy(key).agg(F.array_sort(F.collect_list(elem)).alias("ids"))
        if by_ord:
            g = g.withColumn("ids", F.transform("ids", lambda x: x[item]))
        return rows(g, tag, key, a="ids")

    u = (rows(tables.queries, "queries", "query_id", v="text", ord_col="ord")
         .unionByName(rows(tables.corpus, "corpus", "doc_id", v="text", ord_col="ord"))
         .unionByName(lists(tables.qrels.where("relevance = 1"), "query_id", "doc_id", "rel"))
         .unionByName(lists(tables.qrels.where("relevance = 0"), "query_id", "doc_id", "neg"))
         .unionByName(rows(tables.answers, "answers", "query_id", v="answer"))
         .unionByName(lists(tables.splits, "split", "query_id", "splits", by_ord=True)))

    kv = F.struct(F.col("k").alias("key"), F.col("v").alias("value"))
    ka = F.struct(F.col("k").alias("key"), F.col("a").alias("value"))

    def ordered(tag):
        picked = F.collect_list(F.when(F.col("t") == tag, F.struct(F.col("o"), kv.alias("kv"))))
        return F.map_from_entries(F.transform(F.array_sort(picked), lambda x: x["kv"]))

    def plain(tag, entry):
        return F.map_from_entries(F.collect_list(F.when(F.col("t") == tag, entry)))

    obj = u.agg(ordered("queries").alias("queries"), ordered("corpus").alias("corpus"),
                plain("rel", ka).alias("relevant_docs"), plain("neg", ka).alias("negative_docs"),
                plain("answers", kv).alias("reference_answers"),
                plain("splits", ka).alias("queries_split"))
    return obj.select(F.to_json(F.struct(*RAG_KEYS)).alias("json"))


def write_rag_json(tables: RagTables, path: str) -> None:
    """Write the dataset JSON object (interop for small datasets: the
    object is assembled in one task by nature of the format)."""
    to_rag_json(tables).coalesce(1).write.mode("overwrite").text(path)
