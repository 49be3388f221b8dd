"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their
Every query reads the driver's tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.plans import oracle_sql as O
from retrievalkit.plans import vector_eval as V
from retrievalkit.session import ensure_checkpoint_dir, materialised, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


# ---- R1 exact search, M7/M8 metrics (flagship) ---------------------------------

for _m in ("cosine", "dot", "sq_l2"):
    register(f"R1_knn_{_m}", O.knn_label_run(_m))(
        lambda spark, sf, _m=_m: V.label_run(spark, sf, _m))


@register("R1_knn_query_blocks", O.knn_label_run("cosine"))
def r1_blocks(spark, sf):
    """Cosine search with many groups of queries (of 32 kB each), some groups and
    a strip of the corpus blocks a task."""
    return V.label_run(spark, sf, "cosine", group_bytes=32 << 10)


@register("R1_knn_clustered_blocks", O.knn_label_run("cosine"))
def r1_clustered(spark, sf):
    """Cosine search over blocks in k-means order, which skips the blocks whose
    ball lies too far away; the rows are those of the full scan."""
    return V.label_run(spark, sf, "cosine", clusters=16)


@register("M7_per_query_metrics", O.label_per_query())
def m7(spark, sf):
    """Per-query nDCG/MAP/recall/P/MRR at 1,3,5,10 of leave-one-out cosine search."""
    return round_doubles(V.label_per_query(spark, sf))


@register("M8_metrics", O.label_metrics())
def m8(spark, sf):
    """Mean metrics (5 decimals) of leave-one-out cosine search; relevance = same label."""
    return V.label_metrics(spark, sf)


# ---- datasets: imports, numbering, splits, selection -------------------------------------

from retrievalkit.operators import sampling as U  # noqa: E402
from retrievalkit.sources import imports as D  # noqa: E402
from retrievalkit.operators import training as T  # noqa: E402
from retrievalkit.sources import testdata  # noqa: E402

RATIO = 0.1   # validation share used by the conversation dataset
SEED = 42


def triples_dataset(spark, sf):
    return D.import_triples(spark, testdata.conversation_pairs(spark, sf).select(
        "query", "positive", "negative", "ord"))


def split_dataset(spark, sf):
    t = triples_dataset(spark, sf)
    return t.with_(splits=U.split_train_val(t.queries, RATIO, SEED))


def judged_dataset(spark, sf):
    corpus, queries, judged = testdata.judgments(spark, sf)
    return D.import_judged(spark, corpus, queries, judged, "o")


@register("D5_import_triples_queries",
          O.with_(O.TRIPLES, "SELECT query_id, text, ord FROM tq"))
def d5_queries(spark, sf):
    """Conversation (query, positive, negative) rows -> queries with q-N ids."""
    return triples_dataset(spark, sf).queries


@register("D5_import_triples_corpus", O.with_(O.TRIPLES, "SELECT doc_id, text, ord FROM tc"))
def d5_corpus(spark, sf):
    """Documents deduplicated by text over both roles, c-N by first appearance."""
    return triples_dataset(spark, sf).corpus


@register("D5_import_triples_qrels", O.with_(O.TRIPLES, "SELECT * FROM tqrels"))
def d5_qrels(spark, sf):
    return triples_dataset(spark, sf).qrels


@register("U1_dense_index", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, n_chars,
           row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ord
    FROM documents""")
def u1(spark, sf):
    """0-based dense position of every document ordered by (n_chars, doc_id)."""
    d = testdata.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "n_chars", F.col("doc_id").alias("_id"))
    return U.dense_index(d, [F.col("n_chars"), F.col("_id")]).drop("_id")


@register("U3_split_train_val",
          O.with_(O.TRIPLES + O.split_sql("tq", RATIO, SEED), "SELECT * FROM tsplits"))
def u3(spark, sf):
    """Exact-size (int(n*0.1)) repeatable validation split of the conversation queries."""
    return split_dataset(spark, sf).splits


@register("U6_split_dev",
          O.with_(O.TRIPLES + O.split_sql("tq", RATIO, SEED) + O.dev_sql(SEED, 0.5),
                  "SELECT * FROM tdev"))
def u6(spark, sf):
    """train -> train/dev (dev = ceil(n/2)), val -> test."""
    return U.split_dev(split_dataset(spark, sf).splits, 0.5, SEED)


@register("U2_select_split", O.with_(
    O.TRIPLES + O.split_sql("tq", RATIO, SEED),
    "SELECT s.query_id, q.text, s.ord FROM tsplits s JOIN tq q USING (query_id) WHERE s.split = 'val'"))
def u2(spark, sf):
    """Validation queries of the conversation dataset, in list order."""
    return U.select_split(split_dataset(spark, sf), "val")


@register("U4_sample_docs", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
    ORDER BY md5('42:sample:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) LIMIT 100""")
def u4(spark, sf):
    """100 documents sampled without replacement (the sampling operator's own k)."""
    d = testdata.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")
    return U.sample_docs(d, 100, SEED)


@register("U5_subset_corpus_qrels", O.with_(O.TRIPLES + """,
    kc AS (SELECT doc_id FROM tc WHERE ord < (SELECT count(*) // 2 FROM tc)),
    kq AS (SELECT query_id, doc_id, relevance FROM tqrels WHERE doc_id IN (SELECT doc_id FROM kc)),
    live AS (SELECT DISTINCT query_id FROM kq WHERE relevance = 1)""",
    "SELECT * FROM kq WHERE query_id IN (SELECT query_id FROM live)"))
def u5(spark, sf):
    """Judgments left after keeping the first half of the documents (the operator's n)."""
    t = triples_dataset(spark, sf)
    return U.subset_corpus(t, t.corpus.count() // 2).qrels


@register("U7_judged_pool", O.with_(O.JUDGED, """
    SELECT * FROM jcorpus WHERE doc_id IN (SELECT doc_id FROM jqrels)"""))
def u7(spark, sf):
    """Corpus restricted to documents judged for the evaluated queries."""
    return U.judged_pool(judged_dataset(spark, sf), None)


@register("D4_import_judged_qrels", O.with_(O.JUDGED, "SELECT * FROM jqrels"))
def d4_qrels(spark, sf):
    """labels(quality) as 0/1 judgments of documents for the query lang-source."""
    return judged_dataset(spark, sf).qrels


@register("D4_import_judged_corpus", O.with_(O.JUDGED, "SELECT * FROM jcorpus"))
def d4_corpus(spark, sf):
    return judged_dataset(spark, sf).corpus


@register("D4_import_judged_queries", O.with_(O.JUDGED, "SELECT * FROM jqueries"))
def d4_queries(spark, sf):
    return judged_dataset(spark, sf).queries


@register("D6_dataset_summary", O.with_(O.TRIPLES + O.split_sql("tq", RATIO, SEED), """
    SELECT (SELECT count(*) FROM tc) AS corpus,
           (SELECT count(*) FROM tsplits WHERE split = 'train') AS train_queries,
           (SELECT count(*) FROM tsplits WHERE split = 'val') AS val_queries"""))
def d6(spark, sf):
    return D.dataset_summary(split_dataset(spark, sf))


@register("D8_check_integrity", O.with_(O.JUDGED + """,
    kc AS (SELECT doc_id FROM jcorpus WHERE md5(doc_id) >= '4'),
    kq AS (SELECT query_id FROM jqueries WHERE md5(query_id) >= '4')""", """
    SELECT 'split_query_missing' AS "check", query_id AS id FROM jqueries WHERE query_id NOT IN (SELECT query_id FROM kq)
    UNION ALL
    SELECT DISTINCT 'judged_query_missing', query_id FROM jqrels WHERE query_id NOT IN (SELECT query_id FROM kq)
    UNION ALL
    SELECT DISTINCT CASE relevance WHEN 1 THEN 'relevant_doc_missing' ELSE 'negative_doc_missing' END, doc_id
    FROM jqrels WHERE doc_id NOT IN (SELECT doc_id FROM kc)"""))
def d8(spark, sf):
    """Dangling references after a quarter of documents and queries is taken away."""
    t = judged_dataset(spark, sf)
    splits = t.queries.select("query_id", F.lit("train").alias("split"), "ord")
    return D.check_integrity(t.with_(splits=splits, corpus=t.corpus.where("md5(doc_id) >= '4'"),
                                     queries=t.queries.where("md5(query_id) >= '4'")))


@register("T1_choose_positive_judged", O.with_(O.JUDGED, """
    SELECT query_id, arg_min(doc_id, md5('42:pos:' || query_id || ':' || doc_id) || doc_id) AS doc_id
    FROM jqrels WHERE relevance = 1 GROUP BY query_id"""))
def t1_judged(spark, sf):
    """One of the many positives of each judged query."""
    return T.choose_positive(judged_dataset(spark, sf), None, 42)


@register("T2_sample_negatives_judged", O.with_(O.JUDGED + """,
    m_ AS (SELECT query_id, count(*) AS m FROM jqrels WHERE relevance = 0 GROUP BY query_id),
    cp_ AS (SELECT n.query_id, n.doc_id, c.copy FROM jqrels n JOIN m_ USING (query_id),
            LATERAL (SELECT unnest(range(1, CAST(greatest(1, ceil(5.0 / m_.m)) AS BIGINT) + 1)) AS copy) c
            WHERE n.relevance = 0)""", """
    SELECT query_id, CAST(rn - 1 AS INTEGER) AS slot, doc_id FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY md5('42:neg:' || query_id || ':' || doc_id || ':' || CAST(copy AS VARCHAR)), doc_id, copy) AS rn
      FROM cp_) t WHERE rn <= 5"""))
def t2_judged(spark, sf):
    """5 negatives per judged query: lists of more and of fewer than 5."""
    return T.sample_negatives(judged_dataset(spark, sf), 5, None, 42)


# ---- text path: embeddings, retrieval, metrics, mining, rerank, training rows ------------

from retrievalkit.operators import embed as E  # noqa: E402
from retrievalkit.operators import metrics as M  # noqa: E402
from retrievalkit.operators import search as R  # noqa: E402
from retrievalkit.plans import text_eval as TX  # noqa: E402

_TX = O.text_ctes()          # all queries, k = 100
_TXV = O.text_ctes("val")    # validation queries, k = 100


@register("E2_hash_embed_corpus", O.with_(_TX, "SELECT id, vec FROM cv"))
def e2(spark, sf):
    """Stand-in encoder over the whole conversation corpus (64 buckets, unit length)."""
    return TX.corpus_vectors(TX.dataset(spark, sf, splits=False))


@register("E5_instruction_query_vectors", O.with_(_TX, "SELECT id, vec FROM qv"))
def e5(spark, sf):
    """Query vectors of texts prefixed with the query instruction."""
    return TX.query_vectors(TX.dataset(spark, sf, splits=False))


@register("E1_embed_encoder_hook", O.with_(_TX, "SELECT id, vec FROM cv"))
def e1(spark, sf):
    """The generic encoder hook (mapInPandas, per-task encoder) with the same rule in Python."""
    t = TX.dataset(spark, sf, splits=False)
    return E.embed(t.corpus.select(F.col("doc_id").alias("id"), "text"),
                   E.hashing_encoder_factory(TX.DIM), role="corpus", batch_size=64)


@register("E4_embed_incremental", O.with_(_TX, "SELECT id, vec FROM cv"))
def e4(spark, sf):
    """Store-backed embedding: encode only texts missing from the store, then join back."""
    import uuid

    from retrievalkit.session import checkpoint_dir

    t = TX.dataset(spark, sf, splits=False)
    store = f"{checkpoint_dir(spark)}/embed-store-{uuid.uuid4().hex}"
    docs = t.corpus.select(F.col("doc_id").alias("id"), "text")
    fn = lambda df: E.hash_embed(df, TX.DIM)
    # first call fills the store with the whole corpus; the second finds every text
    E.embed_incremental(docs, store, "hash64", embed_fn=fn, role="corpus").write.format(
        "noop").mode("overwrite").save()
    return E.embed_incremental(docs, store, "hash64", embed_fn=fn, role="corpus")


@register("E6_prepare_corpus", O.with_(_TX, """
    SELECT tc.doc_id, tc.text, cv.vec FROM tc JOIN cv ON cv.id = tc.doc_id"""))
def e6(spark, sf):
    t = TX.dataset(spark, sf, splits=False)
    return E.prepare_corpus(t.corpus, lambda df: E.hash_embed(df, TX.DIM))


@register("R2_retrieve", O.with_(_TX, "SELECT * FROM trun"))
def r2(spark, sf):
    """Top-100 of every conversation query, score = 1 / (1 + squared L2)."""
    return TX.run(TX.dataset(spark, sf, splits=False))


@register("R3_check_scores", O.with_(_TX, """
    SELECT query_id, 'score_range' AS problem FROM drun GROUP BY query_id
    HAVING NOT bool_or(score BETWEEN 0.0 AND 1.0)"""))
def r3(spark, sf):
    """Queries none of whose raw distances lies in [0, 1]."""
    return R.check_scores(TX.distance_run(TX.dataset(spark, sf, splits=False)))


@register("R4_mine_hard_negatives", O.with_(_TX + """,
    trainq AS (SELECT query_id FROM tsplits WHERE split = 'train'),
    haspos AS (SELECT DISTINCT query_id FROM tqrels WHERE relevance = 1),
    win AS (SELECT query_id, doc_id FROM trun
            WHERE rank > 50 AND rank <= 100
              AND query_id IN (SELECT query_id FROM haspos)
              AND query_id IN (SELECT query_id FROM trainq))""", """
    SELECT query_id, doc_id, 0 AS relevance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
                                   ORDER BY md5('42:neg:' || query_id || ':' || doc_id), doc_id) AS rn
      FROM win) w WHERE rn <= 15"""))
def r4(spark, sf):
    """15 negatives per train query sampled from ranks 51..100 of its top-100 run."""
    t = TX.dataset(spark, sf)
    return R.mine_hard_negatives(TX.run(t, "train"), t.qrels, start=50, stop=100, n=15, seed=42)


@register("R6_rerank_pairs", O.with_(_TX, """
    SELECT r.query_id, r.doc_id, r.rank, q.text AS query_text, c.text AS doc_text
    FROM trun r JOIN tq q USING (query_id) JOIN tc c USING (doc_id)"""))
def r6(spark, sf):
    """(query text, document text) pairs of the first 100 candidates per query."""
    t = TX.dataset(spark, sf, splits=False)
    return R.rerank_pairs(TX.run(t), t.queries, t.corpus)


_PAIR128 = (O.text_vectors(None, 128, "qv128", "cv128") + """,
  cand AS (SELECT run_id, query_id, doc_id FROM trun),
  ps AS (SELECT cand.query_id, cand.doc_id,
                round(coalesce(""" + O.score_sql("cosine", "q.vec::DOUBLE[]", "c.vec::DOUBLE[]") + """, 0.0), 6) AS score
         FROM cand JOIN qv128 q ON q.id = cand.query_id JOIN cv128 c ON c.id = cand.doc_id)""")


@register("R5_rerank", O.with_(_TX + _PAIR128, """
    SELECT 'hash64' AS run_id, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ps) t"""))
def r5(spark, sf):
    """First 100 candidates re-scored by a 128-bucket cosine pair scorer and re-sorted."""
    t = TX.dataset(spark, sf, splits=False)
    run = materialised(TX.run(t), "run")
    ps = TX.pair_scores(R.rerank_pairs(run, t.queries, t.corpus), t)
    return R.rerank(run, ps)


@register("M1_build_qrels", O.with_(O.TRIPLES, "SELECT DISTINCT query_id, doc_id, 1 AS relevance FROM tqrels WHERE relevance = 1"))
def m1(spark, sf):
    return M.build_qrels(TX.dataset(spark, sf, splits=False).qrels)


_TXPQ = O.per_query_from(
    "SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM trun r "
    "LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM tqrels WHERE relevance = 1) q USING (query_id, doc_id)",
    "SELECT query_id, count(DISTINCT doc_id) AS num_rel FROM tqrels WHERE relevance = 1 GROUP BY query_id")


def _text_per_query(spark, sf, split):
    return round_doubles(TX.run_benchmark(TX.dataset(spark, sf, splits=split is not None), split,
                                          per_query=True))


for _name, _metric in (("M2_ndcg_at_k", "ndcg"), ("M3_map_at_k", "map"),
                       ("M4_recall_at_k", "recall"), ("M5_precision_at_k", "precision"),
                       ("M6_mrr_at_k", "mrr")):
    _cols = ", ".join(f"{_metric}_at_{k}" for k in TX.KS)
    register(_name, O.with_(_TX, f"SELECT run_id, query_id, {_cols} FROM ({_TXPQ}) p"))(
        lambda spark, sf, _metric=_metric: _text_per_query(spark, sf, None).select(
            "run_id", "query_id", *[f"{_metric}_at_{k}" for k in TX.KS]))


@register("M9_run_benchmark", O.with_(_TXV, O.metrics_from(O.per_query_from(
    "SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM trun r "
    "LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM tqrels WHERE relevance = 1) q USING (query_id, doc_id)",
    "SELECT query_id, count(DISTINCT doc_id) AS num_rel FROM tqrels WHERE relevance = 1 GROUP BY query_id",
    digits=None))))
def m9(spark, sf):
    """Evaluate the validation split end to end: embed, search top-100, score at 1,3,5,10."""
    return TX.run_benchmark(TX.dataset(spark, sf), "val")


@register("M1_passage_qrels", """
    SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS relevance
    FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def m1_passages(spark, sf):
    """Which documents contain which benchmark item: the relevance of the passage dataset."""
    return testdata.passages(spark, sf).qrels


@register("M9_run_benchmark_passages", O.with_(O.PASSAGES + O.text_vectors() + O.text_distance_run(), O.metrics_from(
    O.per_query_from(
        "SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM trun r "
        "LEFT JOIN tqrels q USING (query_id, doc_id)",
        "SELECT query_id, count(DISTINCT doc_id) AS num_rel FROM tqrels GROUP BY query_id", digits=None))))
def m9_passages(spark, sf):
    """Every benchmark item as a query over all documents, end to end: relevance by
    containment, embed, search top-100, score at 1,3,5,10."""
    return TX.run_benchmark(testdata.passages(spark, sf), None)


@register("M10_compare_runs", O.with_(
    "x_ AS (" + O.label_metrics("cosine") + " UNION ALL " + O.label_metrics("dot")
    + " UNION ALL " + O.label_metrics("sq_l2") + """),
    l_ AS (UNPIVOT (SELECT * EXCLUDE (n_run_queries, n_judged_queries) FROM x_)
           ON COLUMNS(* EXCLUDE (run_id)) INTO NAME name VALUE value),
    ll_ AS (SELECT run_id, regexp_extract(name, '^([a-z]+)_at_', 1) AS metric,
                   CAST(regexp_extract(name, '_at_([0-9]+)$', 1) AS INTEGER) AS k, value FROM l_)""",
    """SELECT a.run_id, a.metric, a.k, a.value, b.value AS base_value,
              round(a.value - b.value, 5) AS delta
       FROM ll_ a LEFT JOIN (SELECT * FROM ll_ WHERE run_id = 'cosine') b USING (metric, k)"""))
def m10(spark, sf):
    """Leave-one-out search with cosine, dot and squared L2 side by side against cosine."""
    runs = [V.label_run(spark, sf, m) for m in ("cosine", "dot", "sq_l2")]
    run = runs[0].unionByName(runs[1]).unionByName(runs[2])
    judged, nr = V.label_judged(spark, sf, run)
    return M.compare_runs(M.compute_metrics(M.per_query_metrics(judged, nr, V.KS), V.KS),
                          "cosine", V.KS)


@register("T1_choose_positive", O.with_(O.TRIPLES, """
    SELECT query_id, arg_min(doc_id, md5('42:pos:' || query_id || ':' || doc_id) || doc_id) AS doc_id
    FROM tqrels WHERE relevance = 1 GROUP BY query_id"""))
def t1(spark, sf):
    return T.choose_positive(TX.dataset(spark, sf, splits=False), None, 42)


_NEG = """,
  negs AS (SELECT DISTINCT query_id, doc_id FROM tqrels WHERE relevance = 0),
  m_ AS (SELECT query_id, count(*) AS m FROM negs GROUP BY query_id),
  cp_ AS (SELECT n.query_id, n.doc_id, c.copy FROM negs n JOIN m_ USING (query_id),
          LATERAL (SELECT unnest(range(1, CAST(greatest(1, ceil(3.0 / m_.m)) AS BIGINT) + 1)) AS copy) c),
  tneg AS (SELECT query_id, CAST(rn - 1 AS INTEGER) AS slot, doc_id FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY md5('42:neg:' || query_id || ':' || doc_id || ':' || CAST(copy AS VARCHAR)), doc_id, copy) AS rn
             FROM cp_) t WHERE rn <= 3)"""


@register("T2_sample_negatives", O.with_(O.TRIPLES + _NEG, "SELECT * FROM tneg"))
def t2(spark, sf):
    """3 negatives per query from a list of 1: oversampled, each id at most ceil(3/1) times."""
    return T.sample_negatives(TX.dataset(spark, sf, splits=False), 3, None, 42)


@register("T3_training_rows", O.with_(O.TRIPLES + _NEG + """,
  tpos AS (SELECT query_id, arg_min(doc_id, md5('42:pos:' || query_id || ':' || doc_id) || doc_id) AS doc_id
           FROM tqrels WHERE relevance = 1 GROUP BY query_id)""", """
    SELECT q.query_id, 'query: ' || q.text AS query, pc.text AS pos,
           max(CASE WHEN n.slot = 0 THEN nc.text END) AS neg_0,
           max(CASE WHEN n.slot = 1 THEN nc.text END) AS neg_1,
           max(CASE WHEN n.slot = 2 THEN nc.text END) AS neg_2
    FROM tq q JOIN tpos p USING (query_id) JOIN tc pc ON pc.doc_id = p.doc_id
    JOIN tneg n ON n.query_id = q.query_id JOIN tc nc ON nc.doc_id = n.doc_id
    GROUP BY q.query_id, q.text, pc.text"""))
def t3(spark, sf):
    """Rows query, pos, neg_0..neg_2 (query instruction on the query side)."""
    rows, _ = T.training_rows(TX.dataset(spark, sf, splits=False), None, 3, TX.QUERY_INSTRUCTION, None, 42)
    return rows


@register("T4_training_pairs", O.with_(O.TRIPLES + """,
  tpos AS (SELECT query_id, arg_min(doc_id, md5('42:pos:' || query_id || ':' || doc_id) || doc_id) AS doc_id
           FROM tqrels WHERE relevance = 1 GROUP BY query_id)""", """
    SELECT q.query_id, q.text AS query, pc.text AS pos
    FROM tq q JOIN tpos p USING (query_id) JOIN tc pc ON pc.doc_id = p.doc_id"""))
def t4(spark, sf):
    rows, _ = T.training_pairs(TX.dataset(spark, sf, splits=False))
    return rows


@register("T5_scored_pairs", O.with_(_TX, """
    SELECT r.query_id, r.doc_id, q.text AS sentence_A, c.text AS sentence_B, r.score
    FROM trun r JOIN tq q USING (query_id) JOIN tc c USING (doc_id)"""))
def t5(spark, sf):
    t = TX.dataset(spark, sf, splits=False)
    return T.scored_pairs(TX.run(t), t)


@register("T6_skipped_queries", O.with_(O.JUDGED, """
    SELECT query_id, 'no_positive' AS reason FROM jqueries
    WHERE query_id NOT IN (SELECT query_id FROM jqrels WHERE relevance = 1)
    UNION ALL
    SELECT query_id, 'no_negative' FROM jqueries
    WHERE query_id IN (SELECT query_id FROM jqrels WHERE relevance = 1)
      AND query_id NOT IN (SELECT query_id FROM jqrels WHERE relevance = 0)"""))
def t6(spark, sf):
    """Judged-dataset queries that training rows with 1 negative would skip, with reason."""
    return T.skipped_queries(judged_dataset(spark, sf), None, 1)


# ---- query synthesis -------------------------------------------------------------------

from retrievalkit.operators import synth as Q  # noqa: E402
from retrievalkit.sources import store as ST  # noqa: E402


def _docs(spark, sf):
    return testdata.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")


@register("Q1_render_prompts", f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(p) AS prompt_key, p AS prompt
    FROM (SELECT doc_id, {O.prompt_sql()} AS p FROM documents) t""")
def q1(spark, sf):
    """The question-generation prompt for every document (whole texts)."""
    return Q.render_prompts(_docs(spark, sf))


@register("Q2_distinct_prompts", f"""
    WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {O.prompt_sql()} AS prompt FROM documents),
         k AS (SELECT doc_id, sha256(prompt) AS prompt_key, prompt FROM p),
         done AS (SELECT DISTINCT k.prompt_key FROM k JOIN labels l ON CAST(l.doc_id AS VARCHAR) = k.doc_id)
    SELECT min(doc_id) AS doc_id, prompt_key, min(prompt) AS prompt FROM k
    WHERE prompt_key NOT IN (SELECT prompt_key FROM done) GROUP BY prompt_key""")
def q2(spark, sf):
    """Prompts still to send: distinct texts, minus those already answered
    (responses exist for the labelled documents)."""
    prompts = Q.render_prompts(_docs(spark, sf))
    lab = testdata.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    done = prompts.join(lab, "doc_id", "left_semi")
    return Q.distinct_prompts(prompts, done)


@register("Q3_parse_qa", O.with_(O.PARSED, "SELECT * FROM parsed"))
def q3(spark, sf):
    """Fenced JSON responses (one per conversation) parsed to question / answer lists."""
    return Q.parse_qa(testdata.qa_responses(spark, sf))


@register("Q4_explode_qa", O.with_(O.PARSED, "SELECT query_id, corpus_id, question, answer FROM qa"))
def q4(spark, sf):
    return Q.explode_qa(Q.parse_qa(testdata.qa_responses(spark, sf)))


@register("Q6_responses_roundtrip", O.with_(O.PARSED, "SELECT * FROM parsed"))
def q6(spark, sf):
    """Responses saved as JSON Lines in the shared folder, loaded back, parsed."""
    import uuid

    from retrievalkit.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/responses-{uuid.uuid4().hex}"
    ST.save_responses(testdata.qa_responses(spark, sf), path, mode="errorifexists")
    return Q.parse_qa(ST.load_responses(spark, path))


def _synthetic(spark, sf):
    qa = Q.explode_qa(Q.parse_qa(testdata.qa_responses(spark, sf)))
    return Q.append_synthetic(judged_dataset(spark, sf), qa)


@register("Q5_append_synthetic_qrels", O.with_(O.JUDGED + "," + O.PARSED, """
    SELECT * FROM jqrels WHERE query_id NOT IN (SELECT query_id FROM qa)
    UNION ALL SELECT query_id, corpus_id AS doc_id, 1 AS relevance FROM qa"""))
def q5_qrels(spark, sf):
    """Judged dataset plus synthetic questions, each relevant to its source document."""
    return _synthetic(spark, sf).qrels


@register("Q5_append_synthetic_splits", O.with_(O.JUDGED + "," + O.PARSED, """
    SELECT query_id, 'train' AS split, row_number() OVER (ORDER BY corpus_id, i) - 1 AS ord FROM qa"""))
def q5_splits(spark, sf):
    return _synthetic(spark, sf).splits


@register("Q5_append_synthetic_queries", O.with_(O.JUDGED + "," + O.PARSED, """
    SELECT query_id, text, ord FROM jqueries
    UNION ALL
    SELECT query_id, question AS text,
           (SELECT count(*) FROM jqueries) + row_number() OVER (ORDER BY corpus_id, i) - 1 AS ord FROM qa"""))
def q5_queries(spark, sf):
    return _synthetic(spark, sf).queries


# ---- NUDGE corpus-vector tuning (conversation dataset, hash vectors) ---------------------

from retrievalkit.operators import nudge as N  # noqa: E402

NUDGE_GAMMA = 0.5


def _round_vec(df, col="vec", digits=9):
    return df.withColumn(col, F.transform(col, lambda x: F.round(x, digits)))


def _nudge_inputs(spark, sf):
    """The dataset and its vectors, written once: targets, gamma and moves read them again."""
    t = TX.dataset(spark, sf)
    return t, materialised(TX.query_vectors(t), "query-vectors"), materialised(TX.corpus_vectors(t), "corpus-vectors")


def _rv(sql_vec_select: str) -> str:
    return f"SELECT id, list_transform(vec, lambda x: round(x, 9)) AS vec FROM ({sql_vec_select}) v"


@register("N1_nudge_targets", O.with_(O.nudge_base(),
          "SELECT doc_id, list_transform(g, lambda x: round(x, 9)) AS g FROM tgt"))
def n1(spark, sf):
    """Per answer document: the sum of its training queries' vectors."""
    t, qv, _ = _nudge_inputs(spark, sf)
    train = t.splits.where("split = 'train'")
    return _round_vec(N.nudge_targets(qv, t.qrels, train), "g")


@register("N2_nudge_m", O.with_(O.nudge_base(), _rv(O.nudge_m_sql(O._dbl(NUDGE_GAMMA)))))
def n2(spark, sf):
    """Corpus vectors moved by gamma = 0.5 toward their training queries (NUDGE-M)."""
    t, qv, cv = _nudge_inputs(spark, sf)
    tg = N.nudge_targets(qv, t.qrels, t.splits.where("split = 'train'"))
    return _round_vec(N.nudge_m(cv, tg, NUDGE_GAMMA))


@register("N3_nudge_n", O.with_(O.nudge_base(), _rv(O.nudge_n_sql(NUDGE_GAMMA))))
def n3(spark, sf):
    """Unit-sphere move with chord <= 0.5 (NUDGE-N)."""
    t, qv, cv = _nudge_inputs(spark, sf)
    tg = N.nudge_targets(qv, t.qrels, t.splits.where("split = 'train'"))
    return _round_vec(N.nudge_n(cv, tg, NUDGE_GAMMA))


def _moved_sql(kind: str) -> str:
    """Vectors moved by the chosen gamma, over CTE ``acc_best``."""
    each = [(g, O.nudge_n_sql(g) if kind == "nudge-n" else O.nudge_m_sql(O._dbl(g))) for g in N.DEFAULT_GRID]
    return ("SELECT id, vec FROM (" + " UNION ALL ".join(f"SELECT {O._dbl(g)} AS gamma, * FROM ({sql}) x" for g, sql in each)
            + ") u WHERE gamma = (SELECT gamma FROM acc_best WHERE best)")


def _tuned_sql(kind: str) -> str:
    return _rv(_moved_sql(kind))


def _choose(kind):
    def run(spark, sf):
        t, qv, cv = _nudge_inputs(spark, sf)
        train = t.splits.where("split = 'train'").select("query_id")
        val = t.splits.where("split = 'val'").select("query_id")
        tg = N.nudge_targets(qv, t.qrels, train)
        vq = qv.join(val.select(F.col("query_id").alias("id")), "id", "left_semi")
        return N.choose_gamma(cv, tg, vq, t.qrels.join(val, "query_id", "left_semi"), kind)
    run.__doc__ = f"Validation top-1 accuracy of every gamma of the grid ({kind}); the best one flagged."
    return run


def _finetune(kind):
    def run(spark, sf):
        t, qv, cv = _nudge_inputs(spark, sf)
        tuned, _, _ = N.nudge_finetune(cv, qv, t.qrels, t.splits, kind)
        return _round_vec(tuned.select("id", "vec"))
    run.__doc__ = f"Tuned corpus: targets from train, gamma chosen on val, {kind} applied."
    return run


for _kind, _tag in (("nudge-n", ""), ("nudge-m", "_m")):
    register(f"N4_choose_gamma{_tag}", O.with_(
        O.nudge_base() + "," + O.nudge_accuracy_sql(N.DEFAULT_GRID, _kind),
        "SELECT gamma, accuracy, n_queries, best FROM acc_best"))(_choose(_kind))
    register(f"N5_nudge_finetune{_tag}", O.with_(
        O.nudge_base() + "," + O.nudge_accuracy_sql(N.DEFAULT_GRID, _kind), _tuned_sql(_kind)))(_finetune(_kind))


def _gamma_steps(kind):
    def run(spark, sf):
        t, qv, cv = _nudge_inputs(spark, sf)
        train = t.splits.where("split = 'train'").select("query_id")
        val = t.splits.where("split = 'val'").select("query_id")
        steps = N.gamma_steps(cv, N.nudge_targets(qv, t.qrels, train), qv, t.qrels.join(val, "query_id", "left_semi"), kind)
        return steps.select(F.round("gamma_lo", 6).alias("gamma_lo"), F.round("gamma_hi", 6).alias("gamma_hi"),
                            "hits", "n_queries", "best")
    run.__doc__ = f"Validation top-1 hits of every gamma up to 2 as exact steps ({kind}); the first best one flagged."
    return run


register("N4_gamma_steps")(_gamma_steps("nudge-n"))
register("N4_gamma_steps_m", O.with_(O.nudge_base() + "," + O.gamma_steps_m_sql(), """
    SELECT round(lo, 6) AS gamma_lo, round(hi, 6) AS gamma_hi, hits, n AS n_queries,
           row_number() OVER (ORDER BY hits DESC, lo, hi) = 1 AS best FROM steps, nq"""))(_gamma_steps("nudge-m"))


@register("N7_changed_vectors", O.with_(O.nudge_base() + f""",
    tn AS ({O.nudge_n_sql(NUDGE_GAMMA)})""", """
    SELECT b.id, round(sqrt(list_reduce(list_transform(list_zip(b.vec::DOUBLE[], a.vec),
             lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)), 9) AS moved_by
    FROM cv b JOIN tn a USING (id)
    WHERE sqrt(list_reduce(list_transform(list_zip(b.vec::DOUBLE[], a.vec),
             lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) > 0"""))
def n7(spark, sf):
    """Which corpus vectors NUDGE-N (gamma 0.5) moved, and how far."""
    t, qv, cv = _nudge_inputs(spark, sf)
    tg = N.nudge_targets(qv, t.qrels, t.splits.where("split = 'train'"))
    return round_doubles(N.changed_vectors(cv, N.nudge_n(cv, tg, NUDGE_GAMMA)), 9)


def _compared_sql() -> str:
    ctes = [O.nudge_base(more=O.dev_sql(SEED, 0.5), splits="tdev")]
    for kind, tag in (("nudge-n", "_n"), ("nudge-m", "_m")):
        ctes.append(O.nudge_accuracy_sql(N.DEFAULT_GRID, kind, "dev", splits="tdev", tag=tag))
        each = " UNION ALL ".join(f"SELECT {O._dbl(g)} AS gamma, * FROM ({O.nudge_n_sql(g) if tag == '_n' else O.nudge_m_sql(O._dbl(g))}) x"
                                  for g in N.DEFAULT_GRID)
        ctes.append(f"moved{tag} AS (SELECT id, vec FROM ({each}) u WHERE gamma = (SELECT gamma FROM acc_best{tag} WHERE best))")
    ctes.append("moved AS (SELECT id, vec::DOUBLE[] AS vec FROM cv)")
    runs = " UNION ALL ".join(f"""
      SELECT '{name}' AS run_id, q.id AS query_id, d.id AS doc_id,
             round({O.score_sql(metric, 'q.vec::DOUBLE[]', 'd.vec')}, 6) AS score FROM qv q, moved{tag} d
      WHERE q.id IN (SELECT query_id FROM tdev WHERE split = 'test')"""
                              for name, metric, tag in (("none", "cosine", ""), ("nudge-n", "cosine", "_n"), ("nudge-m", "dot", "_m")))
    ctes.append(f"""runs AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id) AS rank
        FROM ({runs}) s WHERE score IS NOT NULL) r WHERE rank <= 10)""")
    per_query = O.per_query_from(
        "SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM runs r "
        "LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM tqrels WHERE relevance = 1) q USING (query_id, doc_id)",
        "SELECT query_id, count(DISTINCT doc_id) AS num_rel FROM tqrels WHERE relevance = 1 GROUP BY query_id", (10,), None)
    ctes.append(f"wide AS ({O.metrics_from(per_query, (10,))})")
    ctes.append("""long AS (SELECT run_id, replace(name, '_at_10', '') AS metric, 10 AS k, value FROM (
        UNPIVOT (SELECT * EXCLUDE (n_run_queries, n_judged_queries) FROM wide) ON COLUMNS(* EXCLUDE (run_id)) INTO NAME name VALUE value) t)""")
    return O.with_(",".join(ctes), """SELECT a.run_id, a.metric, a.k, a.value, b.value AS base_value, round(a.value - b.value, 5) AS delta
        FROM long a LEFT JOIN (SELECT * FROM long WHERE run_id = 'none') b USING (metric, k)""")


@register("M10_compare_tuned_runs", _compared_sql())
def m10_tuned(spark, sf):
    """No tuning, NUDGE-M and NUDGE-N side by side on the test split (metrics at 10)."""
    from retrievalkit.plans.pipelines import compare_tuned

    t, qv, cv = _nudge_inputs(spark, sf)
    return compare_tuned(t.with_(splits=U.split_dev(t.splits, 0.5, SEED)), qv, cv)


_NEW_DOC = "md5('42:insert:' || {c}) < '8'"   # hash halves: old corpus vs inserted batch


def _insert(kind):
    def run(spark, sf):
        t, qv, cv = _nudge_inputs(spark, sf)
        is_new = F.md5(F.concat(F.lit("42:insert:"), F.col("id"))) < "8"
        old, new = cv.where(~is_new), cv.where(is_new)
        out, _ = N.nudge_insert(old, new, qv, t.qrels, t.splits, kind)
        return _round_vec(out)
    run.__doc__ = (f"Insert half of the corpus (hash halves) into the other half and tune ({kind}) only the "
                   "inserted documents; the old vectors compete but stay as they are.")
    return run


for _kind, _tag in (("nudge-n", ""), ("nudge-m", "_m")):
    register(f"N6_nudge_insert{_tag}", O.with_(
        O.nudge_base(doc_filter=_NEW_DOC.format(c="r.doc_id")) + ","
        + O.nudge_accuracy_sql(N.DEFAULT_GRID, _kind, doc_filter=_NEW_DOC.format(c="r.doc_id")),
        _tuned_sql(_kind)))(_insert(_kind))


def _insert_kept(kind):
    def run(spark, sf):
        from retrievalkit.operators import topk

        t, qv, cv = _nudge_inputs(spark, sf)
        is_new = F.md5(F.concat(F.lit("42:insert:"), F.col("id"))) < "8"
        kept = topk.start_run(qv, cv.where(~is_new), 10, N.search_metric(kind))
        _, _, kept = N.nudge_insert_kept(kept, cv.where(~is_new), cv.where(is_new), t.qrels, t.splits, kind)
        return topk.run_table(kept, "kept")
    run.__doc__ = (f"The top 10 of every query, kept up to date while half of the corpus is inserted and tuned ({kind}): "
                   "the first half is searched once, the rest is merged into its lists.")
    return run


for _kind, _tag in (("nudge-n", ""), ("nudge-m", "_m")):
    register(f"N6_insert_kept_run{_tag}", O.with_(
        O.nudge_base(doc_filter=_NEW_DOC.format(c="r.doc_id")) + ","
        + O.nudge_accuracy_sql(N.DEFAULT_GRID, _kind, doc_filter=_NEW_DOC.format(c="r.doc_id"))
        + f", moved_vecs AS ({_moved_sql(_kind)})", f"""
        SELECT 'kept' AS run_id, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT q.id AS query_id, d.id AS doc_id,
                   round({O.score_sql(N.search_metric(_kind), 'q.vec::DOUBLE[]', 'd.vec')}, 6) AS score
            FROM qv q, moved_vecs d) s WHERE score IS NOT NULL) r WHERE rank <= 10"""))(_insert_kept(_kind))


_SEARCHES = "vec_id % 50 = 0"          # a search takes these rows as queries, against all rows
_GONE = "md5('42:gone:' || {id}) < '4'"


@register("R1_kept_run", f"""
    SELECT 'kept' AS run_id, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.id AS query_id, c.id AS doc_id, round({O.score_sql("cosine")}, 6) AS score
        FROM ({O.VEC} WHERE {_SEARCHES}) q, (SELECT * FROM ({O.VEC}) v WHERE NOT {_GONE.format(id="id")}) c) s
      WHERE score IS NOT NULL) r WHERE rank <= 10""")
def r1_kept(spark, sf):
    """Top 10 by cosine of the embeddings with ids divisible by 50, kept exact while
    the corpus of all embeddings arrives in three batches and a quarter of it leaves."""
    from retrievalkit.operators import topk

    v = testdata.vectors(spark, sf).select("id", "vec")
    batch = [v.where(F.col("id").cast("long") % 3 == i) for i in range(3)]
    kept = topk.start_run(v.where(F.col("id").cast("long") % 50 == 0), batch[0], 10, "cosine")
    for more in batch[1:]:
        kept = topk.insert_docs(kept, more)
    gone = F.expr(_GONE.format(id="id"))
    return topk.run_table(topk.remove_docs(kept, v.where(gone), v.where(~gone)), "kept")


# ---- stores: dataset JSON (D1/D2), Parquet tables (D3), runs (D7) ------------------------


def _scratch(spark, name):
    import uuid

    from retrievalkit.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _json_roundtrip(spark, sf):
    path = _scratch(spark, "ragjson")
    ST.write_rag_lines(TX.build_dataset(spark, sf), path)
    return ST.read_rag_lines(spark, path)


@register("D1_read_rag_json_corpus", O.with_(O.TEXT_BASE, "SELECT doc_id, text, ord FROM tc"))
def d1_corpus(spark, sf):
    """Conversation dataset written as JSON lines by key (D2) and read back."""
    return _json_roundtrip(spark, sf).corpus


@register("D2_write_rag_json_splits", O.with_(O.TEXT_BASE, "SELECT * FROM tsplits"))
def d2_splits(spark, sf):
    """Split lists survive the JSON round trip in order."""
    return _json_roundtrip(spark, sf).splits


@register("D1_read_rag_json_qrels", O.with_(O.TEXT_BASE, "SELECT * FROM tqrels"))
def d1_qrels(spark, sf):
    return _json_roundtrip(spark, sf).qrels


@register("D3_save_load_tables", O.with_(O.TEXT_BASE, "SELECT * FROM tqrels"))
def d3(spark, sf):
    """Native Parquet store round trip of the conversation dataset."""
    path = _scratch(spark, "tables")
    ST.save_tables(TX.build_dataset(spark, sf), path)
    return ST.load_tables(spark, path).qrels


@register("D7_write_read_run", O.with_(_TX, "SELECT * FROM trun"))
def d7(spark, sf):
    """A run persisted partitioned by run_id and read back."""
    path = _scratch(spark, "runs")
    ST.write_run(TX.run(TX.dataset(spark, sf)), path)
    return ST.read_run(spark, path)


@register("E3_l2_normalize", """
    SELECT CAST(vec_id AS VARCHAR) AS id,
           CASE WHEN sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0
                THEN list_transform(embedding::DOUBLE[],
                       lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))
                ELSE embedding::DOUBLE[] END AS vec
    FROM embeddings""")
def e3(spark, sf):
    """Every embedding scaled to unit length in double (zero stays zero)."""
    from retrievalkit.functions.vectors import l2_normalize

    v = testdata.vectors(spark, sf)
    return v.select("id", l2_normalize("vec").alias("vec"))
