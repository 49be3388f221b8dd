"""R1 strategies against brute force; metric rules (F7 quirks)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievalkit.functions import vectors as VX
from retrievalkit.operators import _kernel
from retrievalkit.operators import metrics as M
from retrievalkit.operators.search import check_scores, knn, mine_hard_negatives, rerank, scan_report, search_blocks
from retrievalkit.operators.vector_files import write_vectors
from tests.conftest import SF01


def brute_knn(q, c, k, metric, exclude_self=False):
    """Expression form (cross join + window): the brute-force reference."""
    from pyspark.sql import Window

    s = {"cosine": VX.cosine, "dot": VX.dot, "sq_l2": VX.sq_l2}[metric]
    j = q.select(F.col("id").alias("query_id"), F.col("vec").alias("a")).crossJoin(
        c.select(F.col("id").alias("doc_id"), F.col("vec").alias("b")))
    if exclude_self:
        j = j.where("query_id <> doc_id")
    j = j.select("query_id", "doc_id", F.round(s("a", "b"), 6).alias("score")).where(
        "score IS NOT NULL")
    o = F.col("score").desc() if metric != "sq_l2" else F.col("score").asc()
    w = Window.partitionBy("query_id").orderBy(o, F.col("doc_id"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def vecs(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
def test_strategies_equal_brute_force(spark, vecs, metric):
    q = vecs.where("id < '2'")   # a slice of queries, all vectors as corpus
    want = rows(brute_knn(q, vecs, 7, metric, exclude_self=True))
    for limit in (32 << 20, 20 * 64 * 8):     # one block of queries, several
        got = rows(knn(q, vecs, 7, metric, exclude_self=True, group_bytes=limit))
        assert got == want, limit


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
def test_bad_vectors_change_no_other_row(spark, metric):
    """Null, null component, NaN, infinite, short, long and empty vectors on
    either side take no part, in one block of queries and in several."""
    rng = random.Random(3)
    good = [(f"d{i:02d}", [rng.random() for _ in range(4)]) for i in range(50)]
    nan, inf = float("nan"), float("inf")
    bad = [("n0", None), ("n1", [1.0, None, 1.0, 1.0]), ("n2", [nan, 1.0, 1.0, 1.0]), ("n3", [inf, 1.0, 1.0, 1.0]),
           ("n4", [1.0, 1.0, 1.0]), ("n5", [1.0] * 5), ("n6", []), ("n7", [-inf, 0.0, 0.0, 0.0])]
    schema = "id string, vec array<float>"
    g, b = spark.createDataFrame(good, schema), spark.createDataFrame(bad, schema)
    q = g.where("id < 'd20'")
    want = rows(knn(q, g, 3, metric))
    assert len(want) == 60
    mixed = g.unionByName(b).repartition(3)
    for limit in (32 << 20, 200):
        assert rows(knn(q.unionByName(b), mixed, 3, metric, group_bytes=limit)) == want
    assert rows(knn(b.where("id in ('n0', 'n6')"), g, 3, metric)) == []


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
def test_blocks_skipped_by_their_ball_change_nothing(spark, metric):
    """Clustered vectors: most pairs are never scored, and the rows are those of a
    full scan, with ties, copies and zero vectors; uniform ones: nothing is lost either."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 4
    near = centres[np.arange(1200) % 20] + 0.1 * rng.normal(size=(1200, 8))
    near[40:80] = near[40]                                 # copies in one crowded place
    near[7] = 0.0
    for points, most in ((near, 0.5), (rng.normal(size=(600, 8)), 1.0)):
        v = spark.createDataFrame([(f"v{i}", p.tolist()) for i, p in enumerate(points)], "id string, vec array<double>").repartition(3)
        plain = write_vectors(v)
        want = rows(search_blocks(plain, plain, 5, metric, exclude_self=True))
        assert len(want) == 5 * (len(points) - (metric == "cosine" and most < 1))
        blocks = write_vectors(v, block_rows=32, clusters=20)
        assert sum(n for _, n, _ in blocks.files) == len(points) and len(blocks.files) >= 20
        assert rows(search_blocks(blocks, blocks, 5, metric, exclude_self=True, group_bytes=32 * 8 * 8)) == want
        seen = scan_report(blocks, blocks, 5, metric, exclude_self=True, group_bytes=32 * 8 * 8).first()
        assert seen["pairs"] == len(points) ** 2 and seen["scored"] <= most * seen["pairs"] and seen["read"] <= seen["blocks"]


def test_a_crowded_cluster_is_many_blocks(spark):
    v = spark.range(3000).selectExpr("cast(id as string) as id", "array(1D + id % 7 * 1e-6, if(id < 20, 9D, 0D)) as vec")
    blocks = write_vectors(v, block_rows=100, clusters=4)
    assert max(n for _, n, _ in blocks.files) <= 100 and sum(n for _, n, _ in blocks.files) == 3000
    assert write_vectors(v.limit(0), clusters=4).files == ()


def test_ties_break_by_doc_id_as_string(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vec array<float>")
    c = spark.createDataFrame([("9", [1.0, 0.0]), ("10", [1.0, 0.0]), ("2", [0.0, 1.0])],
                              "id string, vec array<float>")
    got = [(r.doc_id, r.rank) for r in knn(q, c, 2, "dot").orderBy("rank").collect()]
    assert got == [("10", 1), ("9", 2)]   # '10' < '9' as strings


def test_fewer_than_k_and_zero_vector(spark):
    q = spark.createDataFrame([("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "id string, vec array<float>")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "id string, vec array<float>")
    got = rows(knn(q, c, 5, "cosine"))
    assert got == [("q", "a", round(1 / math.sqrt(2), 6), 1)]


def test_many_exact_duplicates_keep_exactly_k(spark):
    c = spark.createDataFrame([(f"d{i:03d}", [0.5, 0.5]) for i in range(300)],
                              "id string, vec array<float>")
    q = spark.createDataFrame([("q", [0.5, 0.5])], "id string, vec array<float>")
    got = knn(q, c, 3, "dot").orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["d000", "d001", "d002"]


def test_round_half_up_matches_spark(spark):
    rng = np.random.default_rng(7)
    xs = list(rng.normal(size=2000)) + [0.1234565, -0.1234565, 2.5e-7, -2.5e-7, 0.0000005]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    spark_r = [r[0] for r in df.select(F.round("x", 6)).collect()]
    ours = _kernel.round_half_up(np.array(xs, dtype=np.float64))
    assert [float(v) for v in ours] == spark_r


# ---- metrics ------------------------------------------------------------------------


def py_metrics(run, qrels, ks):
    out = {}
    by_q = {}
    for q, d, s, r in run:
        by_q.setdefault(q, []).append((d, s, r))
    rel = {}
    for q, d in qrels:
        rel.setdefault(q, set()).add(d)
    evals = {}
    for q, docs in by_q.items():
        ev = sorted(docs, key=lambda x: (-x[1], [-ord(ch) for ch in x[0]]))
        retr = sorted(docs, key=lambda x: (-x[1], x[2]))
        m = {}
        R = len(rel.get(q, ()))
        for k in ks:
            top = ev[:k]
            hits = [1 if d in rel.get(q, ()) else 0 for d, _, _ in top]
            if R:
                dcg = sum(h / math.log2(i + 2) for i, h in enumerate(hits))
                idcg = sum(1 / math.log2(i + 2) for i in range(min(k, R)))
                m[f"ndcg_at_{k}"] = dcg / idcg
                ap = sum(sum(hits[:i + 1]) / (i + 1) for i, h in enumerate(hits) if h)
                m[f"map_at_{k}"] = ap / R
                m[f"recall_at_{k}"] = sum(hits) / R
                m[f"precision_at_{k}"] = sum(hits) / k
            rr = 0.0
            for i, (d, _, _) in enumerate(retr[:k]):
                if d in rel.get(q, ()):
                    rr = 1 / (i + 1)
                    break
            m[f"mrr_at_{k}"] = rr
        evals[q] = m
    for name in M.metric_columns(ks):
        vals = [m[name] for m in evals.values() if name in m]
        out[name] = round(sum(vals) / len(vals), 5) if vals else None
    return out


def test_metrics_match_brute_force(spark):
    random.seed(3)
    run, qrels = [], []
    for qi in range(12):
        q = f"q{qi}"
        for r in range(1, 9):
            run.append((q, f"{random.randint(0, 30)}x{r}", float(random.choice([0.9, 0.5, 0.5, 0.1])), r))
        if qi % 4:   # some queries have no judgments at all
            qrels += [(q, d) for (qq, d, _, _) in run if qq == q and random.random() < 0.3]
            qrels.append((q, "never-retrieved"))
    ks = (1, 3, 5, 10)
    want = py_metrics(run, qrels, ks)
    rdf = spark.createDataFrame(run, "query_id string, doc_id string, score double, rank int")
    qdf = spark.createDataFrame([(q, d, 1) for q, d in qrels],
                                "query_id string, doc_id string, relevance int")
    for parts in (1, 7):
        got = M.evaluate(rdf.repartition(parts), qdf, ks).first().asDict()
        for name, v in want.items():
            assert got[name] == pytest.approx(v, abs=1e-9), name


def test_binary_identities_and_monotone_recall(spark):
    from retrievalkit.plans import vector_eval as V

    m = V.label_metrics(spark, SF01).first().asDict()
    assert m["precision_at_1"] == m["ndcg_at_1"] == m["mrr_at_1"]
    assert m["map_at_1"] == m["recall_at_1"]
    assert m["recall_at_1"] <= m["recall_at_3"] <= m["recall_at_5"] <= m["recall_at_10"]


def test_empty_run_gives_no_rows(spark):
    rdf = spark.createDataFrame([], "run_id string, query_id string, doc_id string, score double, rank int")
    qdf = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, relevance int")
    assert M.evaluate(rdf, qdf).count() == 0


def test_check_scores_any_not_all(spark):
    run = spark.createDataFrame([("a", "d1", 1.5, 1), ("a", "d2", 0.5, 2), ("b", "d1", 2.0, 1)],
                                "query_id string, doc_id string, score double, rank int")
    qs = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    rep = sorted(tuple(r) for r in check_scores(run, qs).collect())
    assert rep == [("b", "score_range"), ("c", "no_result")]
    assert sorted(r.query_id for r in check_scores(run, qs, drop=True).select("query_id").distinct().collect()) == ["a"]


def test_mining_window_and_errors(spark):
    run = spark.createDataFrame([("q", f"d{r:03d}", 1.0 / r, r) for r in range(1, 101)],
                                "query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("q", "d001", 1)], "query_id string, doc_id string, relevance int")
    got = mine_hard_negatives(run, qrels, n=15).collect()
    assert len(got) == 15 and all(51 <= int(r.doc_id[1:]) <= 100 for r in got)
    short = run.where("rank <= 60")
    with pytest.raises(Exception):
        mine_hard_negatives(short, qrels, n=15).collect()
    assert mine_hard_negatives(short, qrels, n=15, on_short="take_all").count() == 10


def test_rerank_drops_unscored_and_resorts(spark):
    run = spark.createDataFrame([("r", "q", "a", 0.9, 1), ("r", "q", "b", 0.8, 2), ("r", "q", "c", 0.7, 3)],
                                "run_id string, query_id string, doc_id string, score double, rank int")
    ps = spark.createDataFrame([("q", "a", 0.1), ("q", "c", 0.5)], "query_id string, doc_id string, score double")
    got = [(r.doc_id, r.rank) for r in rerank(run, ps, 3).orderBy("rank").collect()]
    assert got == [("c", 1), ("a", 2)]


def test_compare_runs_long_and_wide(spark):
    m = spark.createDataFrame([("a", 0.5, 0.25), ("b", 0.75, 0.5)],
                              "run_id string, ndcg_at_1 double, map_at_1 double")
    m = m.select("run_id", "ndcg_at_1", "map_at_1", *[F.lit(0.0).alias(f"{x}_at_1")
                                                    for x in ("recall", "precision", "mrr")])
    long = {(r.run_id, r.metric): r.delta for r in M.compare_runs(m, "a", (1,)).collect()}
    assert long[("b", "ndcg")] == 0.25 and long[("a", "map")] == 0.0
    wide = {r.metric: (r.a, r.b) for r in M.compare_runs_wide(m, ["a", "b"], (1,)).collect()}
    assert wide["ndcg"] == (0.5, 0.75)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.sampled_from([0.1, 0.5, 0.5, 0.9])),
                min_size=1, max_size=40),
       st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=25))
def test_metrics_property_against_brute_force(spark, run_rows, qrel_rows):
    seen, run = set(), []
    for q, d, s in run_rows:                      # one score per (query, doc)
        if (q, d) not in seen:
            seen.add((q, d))
            run.append((f"q{q}", str(d), s))
    ranked = []
    for q in sorted({r[0] for r in run}):         # retrieval order: score desc, then doc id
        docs = sorted([r for r in run if r[0] == q], key=lambda r: (-r[2], r[1]))
        ranked += [(q, d, s, i + 1) for i, (_, d, s) in enumerate(docs)]
    qrels = sorted({(f"q{q}", str(d)) for q, d in qrel_rows})
    ks = (1, 3, 5)
    want = py_metrics(ranked, qrels, ks)
    rdf = spark.createDataFrame(ranked, "query_id string, doc_id string, score double, rank int")
    qdf = spark.createDataFrame([(q, d, 1) for q, d in qrels] or [("none", "none", 0)],
                                "query_id string, doc_id string, relevance int")
    got = M.evaluate(rdf, qdf, ks).first().asDict()
    for name, v in want.items():
        if v is None:
            assert got[name] is None, name
        else:
            assert got[name] == pytest.approx(v, abs=1e-9), name
