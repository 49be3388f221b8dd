"""Registered queries of the subpackage: each runs its operator with production
parameters over its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_minhash_dedup")
def op1(spark, sf):
    """Near duplicates on 3-word shingles at 0.85: component and kept flag per document."""
    from retrievalkit.llm.minhash_dedup import near_duplicates

    out = near_duplicates(table(spark, sf, "documents"), k=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.expr("id = component"), F.lit(True)).alias("kept"))


@register("op10_decontaminate")
def op10(spark, sf):
    """Documents that hold a benchmark item: pairs with their exact shingle containment."""
    from retrievalkit.llm.decontaminate import contained_items

    return contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op2_repetition_quality")
def op2(spark, sf):
    """Repetition rules over whole texts: base counts, covered part, longest repeat, verdict."""
    from retrievalkit.llm.repetition import repetition_quality

    return repetition_quality(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@register("op3_toxicity")
def op3(spark, sf):
    """Toxicity score of every document by the weighted pattern grammar."""
    from retrievalkit.llm.toxicity import fit, toxicity

    docs = table(spark, sf, "documents")
    return toxicity(docs, fit(docs, table(spark, sf, "labels"))).select(
        F.col("id").alias("doc_id"), F.expr("coalesce(crc32(cast(id as string)) % 5 = 0, false)").alias("held_out"),
        "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"), "matches")


@register("op8_packing")
def op8(spark, sf):
    """Sum-of-squares packing of all documents into sequences of 4096 ids."""
    from retrievalkit.llm.packing import pack

    return pack(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@register("op9_token_counts")
def op9(spark, sf):
    """Suffix sums of the token-length histogram: one row per length as context limit."""
    from retrievalkit.llm.token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(table(spark, sf, "documents")))


_OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
first AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to, true AS intact
FROM p LEFT JOIN first ON first.d = p.d AND n >= 100
"""


@register("op4_warc_round_trip", _OP4_SQL)
def op4(spark, sf):
    """Write all pages as sharded WARC files, read them back and report each record."""
    from retrievalkit.llm._spark import shared_folder
    from retrievalkit.llm.warc import read_warc, write_warc

    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf, "pages"), folder)
    return read_warc(spark, folder, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        "refers_to", "intact")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (host, path)
"""


@register("op5_url_rules", _OP5_SQL)
def op5(spark, sf):
    """Verdict of every page url by the nested host and path rules."""
    from retrievalkit.llm.url_rules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@register("op6_html_text")
def op6(spark, sf):
    """Main text of every page."""
    from retrievalkit.llm.html_text import extract_text

    return extract_text(table(spark, sf, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op7_secret_scan")
def op7(spark, sf):
    """Secrets in every document: base patterns and randomness tests, as spans."""
    from retrievalkit.llm.secret_scan import joined, scan_secrets

    return scan_secrets(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "n_random",
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


_OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
own AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs WHERE length(raw) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, k, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode(doc_id::VARCHAR || ':' || run))),
        lambda i: ('0x' || substr(hex(encode(doc_id::VARCHAR || ':' || run)), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS inv
  FROM own),
hashed AS (SELECT run, k, xor(inv, 4294967295) AS h FROM coded),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
              ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gaps AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS gap
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words) t),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM gaps a JOIN words b ON a.gap = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM gaps a JOIN words b ON a.gap = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
top AS (SELECT word, min(other) AS other FROM near JOIN best USING (word) WHERE near.m = best.m GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN t.other END AS form,
         CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word) LEFT JOIN top t USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


@register("op11_spelling_variants", _OP11_SQL)
def op11(spark, sf):
    """Words one edit from another, with the frequent form and the root of each."""
    from retrievalkit.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf, "documents"))


@register("op13_token_files")
def op13(spark, sf):
    """Token ids of all documents written as binary files with Elias-Fano boundaries, and read back."""
    from retrievalkit.llm._spark import shared_folder
    from retrievalkit.llm.token_files import read_documents, write_ids

    folder = shared_folder(spark, "ids")
    write_ids(table(spark, sf, "documents"), folder)
    return read_documents(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
stats AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM sizes),
ms AS (SELECT doc_id, 25 + (75 * n * total) // length AS m FROM sizes, stats),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) t GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY term),
ws AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM dfs, stats),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN ws USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) t
WHERE rank <= 10
"""


@register("op12_lexical_search", _OP12_SQL)
def op12(spark, sf):
    """The ten best documents of every benchmark item by term weights."""
    from retrievalkit.llm.lexical_search import ranked_search

    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark")).withColumnRenamed("id", "doc_id")
