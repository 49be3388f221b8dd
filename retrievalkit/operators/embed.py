"""Embedding data work.

* E1 ``embed``: any user encoder (``list[str] -> ndarray``) runs inside
  ``mapInPandas``; it is built once per task by a picklable factory and fed
  slices of ``batch_size`` texts, order kept.
* E2 ``hash_embed``: a model-free stand-in encoder, all JVM: ASCII word
  tokens, md5 bucket, counts, L2 normalised. Lets the text pipelines run and be
  checked against SQL without model weights.
* E3 ``l2_normalize`` lives in ``functions.vectors``.
* E4 ``embed_incremental``: a store (``embed_store``) keyed per row by (model,
  role, instruction, normalize, md5(text)); only missing texts are encoded.
* E5 ``with_instruction``, E6 ``prepare_corpus``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrievalkit.functions.text import with_prefix
from retrievalkit.functions.vectors import l2_normalize
from retrievalkit.operators import embed_store
from retrievalkit.session import materialised, ship_package

VEC_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])
TOKEN_PATTERN = "([a-z0-9]+)"
ROLES = ("corpus", "query", "none")


def with_instruction(df: DataFrame, col: str, instruction: str | None) -> DataFrame:
    """E5: prefix ``col`` with the instruction (None / '' = unchanged)."""
    return df.withColumn(col, with_prefix(col, instruction))


def _role_instruction(role, query_instruction, passage_instruction):
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    return {"corpus": passage_instruction, "query": query_instruction, "none": None}[role]


def embed(df: DataFrame, encoder_factory: Callable[[], Callable], *, id_col: str = "id",
          text_col: str = "text", role: str = "none", query_instruction: str | None = None,
          passage_instruction: str | None = None, batch_size: int = 256,
          corpus_batch_size: int = 0, normalize: bool = True) -> DataFrame:
    """``(id, vec array<float>)`` for every row of ``df``.

    Role ``corpus`` uses the passage instruction and ``corpus_batch_size``
    (0 -> ``batch_size``); ``query`` the query instruction; ``none`` neither.
    """
    ship_package(df.sparkSession)
    instr = _role_instruction(role, query_instruction, passage_instruction)
    bs = corpus_batch_size if (role == "corpus" and corpus_batch_size > 0) else batch_size
    src = df.select(F.col(id_col).cast("string").alias("id"),
                    with_prefix(text_col, instr).alias("text"))

    def run(batches):
        import numpy as np
        import pandas as pd

        encode = encoder_factory()
        for pdf in batches:
            for s in range(0, len(pdf), bs):
                part = pdf.iloc[s:s + bs]
                vecs = np.asarray(encode(part["text"].fillna("").tolist()), dtype=np.float32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(vecs)})

    out = src.mapInPandas(run, VEC_SCHEMA)
    if normalize:
        out = out.withColumn("vec", l2_normalize("vec").cast("array<float>"))
    return out


def token_bucket(token, dim: int):
    """md5 of the token, first 4 hex digits as an integer, modulo dim."""
    return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % F.lit(dim)).cast("int")


def hash_embed(df: DataFrame, dim: int = 64, *, id_col: str = "id", text_col: str = "text",
               instruction: str | None = None, normalize: bool = True) -> DataFrame:
    """Hashed token counts -> ``(id, vec array<float>)``; a text without
    tokens gives the zero vector (E3 keeps it zero).

    Tokens are exploded (rows grow with the text, never a whole text in one
    value), counted per (id, bucket) with map-side partial aggregation, then
    assembled per id.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"),
                    with_prefix(text_col, instruction).alias("text"))
    toks = src.select("id", F.explode_outer(
        F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 1)).alias("tok"))
    counts = (toks.select("id", F.when(F.col("tok").isNotNull(), token_bucket(F.col("tok"), dim))
                          .alias("b"))
              .groupBy("id", "b").agg(F.count(F.lit(1)).alias("c")))
    own = F.when(F.col("b").isNotNull(), F.col("c").cast("double"))
    # counts are whole numbers, so the norm is the same in any order of summing
    per_id = counts.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", own.alias("c"))))).alias("m"),
        F.sqrt(F.coalesce(F.sum(own * own), F.lit(0.0))).alias("n"))
    scale = F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(1.0)) if normalize else F.lit(1.0)
    dense = per_id.select("id", F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / scale).alias("vec"))
    return dense.select("id", F.col("vec").cast("array<float>").alias("vec"))


class HashingEncoder:
    """The E2 rule as a Python encoder for E1 (``list[str] -> ndarray``),
    for running the generic hook without model weights."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts):
        import hashlib
        import re

        import numpy as np

        pat = re.compile(TOKEN_PATTERN)
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for r, t in enumerate(texts):
            for tok in pat.findall(t.lower()):
                out[r, int(hashlib.md5(tok.encode()).hexdigest()[:4], 16) % self.dim] += 1.0
        return out


def hashing_encoder_factory(dim: int = 64):
    return lambda: HashingEncoder(dim)


# ---- E4: incremental store ----------------------------------------------------------

def embed_incremental(df: DataFrame, store_path: str, model: str, *,
                      embed_fn: Callable[[DataFrame], DataFrame], id_col: str = "id",
                      text_col: str = "text", role: str = "none",
                      instruction: str | None = None, normalize: bool = True,
                      buckets: int = embed_store.BUCKETS) -> DataFrame:
    """Vectors for ``df`` reusing the store; texts not yet stored under
    this (model, role, instruction, normalize) are encoded by ``embed_fn``
    (a DataFrame ``(id, text) -> (id, vec)`` function, e.g. E1 or E2) and
    appended to the store. Changed text -> new key, never stale; a null text
    counts as the empty one, as in E1.

    The store holds batches of ``buckets`` hash buckets (``embed_store``): rows
    are joined with it bucket by bucket, the misses are encoded and appended as
    a batch, and the fresh vectors are united with the hits. Only a store that
    does not exist counts as empty; any other error is raised.
    """
    instr = instruction or ""
    src = df.select(F.col(id_col).cast("string").alias("id"),
                    with_prefix(F.coalesce(F.col(text_col), F.lit("")), instruction).alias("text"))
    looked = embed_store.lookup(src.withColumn("text_md5", F.md5("text")), store_path, model, role, instr, normalize)
    missing = looked.where("vec is null").groupBy("text_md5").agg(F.first("text").alias("text"))
    fresh = materialised(embed_fn(missing.select(F.col("text_md5").alias("id"), "text")).select(
        F.col("id").alias("text_md5"), "vec"), "embed-fresh")
    if not fresh.isEmpty():
        embed_store.append(fresh.select(
            F.lit(model).alias("model"), F.lit(role).alias("role"), F.lit(instr).alias("instruction"),
            F.lit(normalize).alias("normalize"), "text_md5", "vec"), store_path, buckets)
    hits = looked.where("vec is not null").select("id", "vec")
    return hits.unionByName(looked.where("vec is null").select("id", "text_md5").join(fresh, "text_md5").select("id", "vec"))


def prepare_corpus(corpus: DataFrame, embed_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of the whole corpus joined with id and text, ready for R1.
    The vectors are written once, so later steps never encode again."""
    vecs = materialised(embed_fn(corpus.select(F.col("doc_id").alias("id"), "text")), "corpus-vectors")
    return corpus.select("doc_id", "text").join(
        vecs.select(F.col("id").alias("doc_id"), "vec"), "doc_id")
