"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm._spark import stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """``large``: every neighbour above ``u`` is linked to the least node of
    ``u``'s neighbourhood; else every neighbour below ``u``, and ``u``, are.
    The least node is an aggregate and comes back by a join, so a node with
    very many neighbours is never one group in one task."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every id that occurs in ``edges(u, v)`` (long
    ids); ``component`` is the smallest id that can be reached.

    Large-star and small-star steps alternate until every component is one
    star; each round is written to the shared folder. Null ids and self links
    are ignored; an empty table gives an empty one.
    """
    cur = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
                 .filter("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        cur = stored(_step(_step(cur, True), False), "edges")
        # bit sums of hashes tell equal edge sets apart without collecting them
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
