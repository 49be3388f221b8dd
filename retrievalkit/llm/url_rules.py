"""URL rules by a sort-merge range join on reversed-host keys.

A key is the reversed host, a separator and the path: ``example.net/en/`` becomes
``net.example<sep>/en/``. A rule fits its host and all subdomains, so a URL is
probed once per suffix of its host; for one suffix, the URLs that a rule fits
are an interval of keys, those that begin with the rule's key. Rules of one
host nest by path. Probes are cut into ranges at sampled keys, every rule goes
to each range that its interval meets, and each range is sorted and swept once
with a stack of the rules that are open at the current key; the top of the
stack is the longest that fits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare

SEP = "\x01"
#: Keys sampled to place the range boundaries (balance only, not results).
SAMPLE = 4096
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url):
    """``(host, path)`` columns: the host after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased; the path from there up to ``?``,
    ``#`` or the end. Both are empty without ``://`` and for null."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _AZ, _AZ.lower()), path


def _reverse(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, kind): rules before the probes they begin at."""
    part, stack = None, []
    for rows in batches:
        found = []
        for p, key, rule, host, path, name, verdict in zip(
                rows["part"], rows["key"], rows["is_rule"], rows["host"], rows["path"], rows["rule"], rows["verdict"]):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule:
                stack.append((key, host, name, verdict))
            elif stack:
                _, at, name, verdict = stack[-1]
                found.append((host, path, name, len(name), len(at), verdict))
        yield pd.DataFrame(found, columns=["host", "path", "rule", "length", "host_length", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", *, default: str = "allow",
               parts: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of
    these names are replaced).

    ``rules``: ``(host, path, verdict)``. A rule fits its host (A-Z lower-cased)
    and all subdomains if the URL's path starts with its own. The longest wins
    (host and path together, then the longer host, then the lesser text);
    of rules that repeat a host and path, ``block`` goes before ``allow``. A URL
    that no rule fits, null ones too, has a null rule and the verdict
    ``default``. Empty tables of pages or rules are fine.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col(f"`{url_col}`"))
    pages = pages.drop("host", "path", "rule", "verdict") if url_col not in ("host", "path", "rule", "verdict") else pages
    judged = pages.withColumn("host", host).withColumn("path", path)
    urls = judged.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    levels = F.explode(F.expr("sequence(1, size(labels))"))
    probes = urls.filter("host != ''").withColumn("labels", labels).withColumn("level", levels).select(
        "host", "path", F.concat(F.array_join(F.expr("reverse(slice(labels, -level, level))"), "."), F.lit(SEP), "path")
        .alias("key"))
    known = rules.select(F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), _AZ, _AZ.lower()).alias("host"),
                         F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                         F.col("verdict").cast("string").alias("verdict"))
    known = known.filter("host != ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select("host", "path", F.concat("host", "path").alias("rule"), "verdict", F.concat(
        F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(SEP), "path").alias("key"))

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = sorted(r["key"] for r in probes.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect())
    cuts = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []

    def place(rule: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                low = [bisect_right(cuts, k) for k in keys]
                # the last key that begins with k sorts before k and the greatest character
                high = [bisect_right(cuts, k + "\U0010ffff") for k in keys] if rule else low
                take = [i for i, (a, b) in enumerate(zip(low, high)) for _ in range(a, b + 1)]
                part = [p for a, b in zip(low, high) for p in range(a, b + 1)]
                out = pa.Table.from_batches([batch]).take(pa.array(take, pa.int64()))
                yield from out.append_column("part", pa.array(part, pa.int32())).combine_chunks().to_batches()
        return of

    cols = ["key", "is_rule", "host", "path", "rule", "verdict"]
    schema = "key string, is_rule boolean, host string, path string, rule string, verdict string, part int"
    none = F.lit(None).cast("string")
    both = known.withColumn("is_rule", F.lit(True)).select(*cols).mapInArrow(place(True), schema).unionByName(
        probes.withColumn("is_rule", F.lit(False)).withColumn("rule", none).withColumn("verdict", none)
        .select(*cols).mapInArrow(place(False), schema))
    swept = both.repartition(n, "part").sortWithinPartitions("part", "key", F.desc("is_rule")).select(
        "part", "key", "is_rule", "host", "path", "rule", "verdict").mapInPandas(
        _sweep, "host string, path string, rule string, length long, host_length long, verdict string")
    best = swept.groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "verdict"), F.struct("length", "host_length", "rule")).alias("won"))
    return judged.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in judged.columns], F.col("won.rule").alias("rule"),
        F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"))
