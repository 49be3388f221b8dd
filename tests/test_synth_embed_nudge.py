"""Synthesis parsing, embedding hooks and NUDGE properties (F7 quirks)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievalkit.operators import embed as E
from retrievalkit.operators import _kernel
from retrievalkit.operators import nudge as N
from retrievalkit.operators import synth as Q
from retrievalkit.tables import RagTables


def test_template_single_pass(spark):
    docs = spark.createDataFrame([("1", "has {num_questions_per_chunk} inside")], "doc_id string, text string")
    p = Q.render_prompts(docs, "A {{x}} {context_str} / {num_questions_per_chunk}", 3).first()
    assert p.prompt == "A {x} has {num_questions_per_chunk} inside / 3"


def test_parse_and_explode_quirks(spark):
    good = '```json\n[{"问题": "12345", "答案": "abcdefg"}, {"问题": "", "答案": "x"}, {"问题": "123456", "答案": "abcdef"}]\n```'
    rows = [("a", good), ("b", "not json at all"), ("c", '```json\n{"问题": "123456", "答案": "abcdef"}\n```'),
            ("d", '[{"问题": "question?", "答案": "answer!"}]'), ("e", None)]
    parsed = Q.parse_qa(spark.createDataFrame(rows, "corpus_id string, response string"))
    by = {r.corpus_id: r for r in parsed.collect()}
    assert by["a"].questions == ["12345", "123456"] and not by["a"].is_malformed
    assert by["b"].questions == [] and by["b"].is_malformed
    assert by["c"].questions == [] and by["c"].is_malformed      # object, not array
    assert by["d"].questions == ["question?"]                      # no fence: raw text
    assert by["e"].is_malformed
    ex = sorted(r.query_id for r in Q.explode_qa(parsed).collect())
    assert ex == ["q-a-1", "q-d-0"]      # "12345" is 5 chars: dropped, id gap kept


def test_append_synthetic(spark):
    t = RagTables.create(
        spark,
        queries=spark.createDataFrame([("q-x-0", "old", 0)], "query_id string, text string, ord long"),
        qrels=spark.createDataFrame([("q-x-0", "zz", 1), ("q-x-0", "n", 0)], "query_id string, doc_id string, relevance int"),
        splits=spark.createDataFrame([("q-x-0", "train", 0)], "query_id string, split string, ord long"))
    qa = spark.createDataFrame([("q-x-0", "x", "new text", "ans"), ("q-y-2", "y", "other", "ans2")],
                               "query_id string, corpus_id string, question string, answer string")
    out = Q.append_synthetic(t, qa)
    assert sorted(tuple(r) for r in out.queries.collect()) == [("q-x-0", "new text", 0), ("q-y-2", "other", 1)]
    assert sorted(tuple(r) for r in out.qrels.collect()) == [
        ("q-x-0", "n", 0), ("q-x-0", "x", 1), ("q-y-2", "y", 1)]
    assert sorted(tuple(r) for r in out.splits.collect()) == [("q-x-0", "train", 0), ("q-y-2", "train", 1)]


def test_hash_embed_and_hook_agree(spark):
    df = spark.createDataFrame([("1", "Hello hello WORLD 42"), ("2", "éèà ---"), ("3", "")], "id string, text string")
    a = {r.id: r.vec for r in E.hash_embed(df, 16).collect()}
    b = {r.id: r.vec for r in E.embed(df, E.hashing_encoder_factory(16), batch_size=2).collect()}
    assert a == b
    assert a["2"] == [0.0] * 16 and a["3"] == [0.0] * 16          # no tokens: zero vector
    assert math.isclose(sum(x * x for x in a["1"]), 1.0, rel_tol=1e-6)


def test_incremental_store_encodes_only_missing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fn(df):
        def count(it):
            for pdf in it:
                calls.add(len(pdf))
                yield pdf
        return E.hash_embed(df.mapInPandas(count, df.schema), 8)

    store = str(tmp_path / "store")
    d1 = spark.createDataFrame([("a", "x y"), ("b", "y z")], "id string, text string")
    E.embed_incremental(d1, store, "m", embed_fn=fn).collect()
    first = calls.value
    d2 = spark.createDataFrame([("a", "x y"), ("c", "new text")], "id string, text string")
    got = E.embed_incremental(d2, store, "m", embed_fn=fn).collect()
    assert len(got) == 2 and calls.value - first == 1


def _nudge_fixture(spark):
    rng = np.random.default_rng(1)
    docs = rng.normal(size=(6, 4))
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    qs = rng.normal(size=(5, 4))
    qs /= np.linalg.norm(qs, axis=1, keepdims=True)
    dv = spark.createDataFrame([(f"d{i}", [float(x) for x in v]) for i, v in enumerate(docs)], "id string, vec array<double>")
    qv = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(qs)], "id string, vec array<double>")
    qrels = spark.createDataFrame([("q0", "d0", 1), ("q1", "d0", 1), ("q2", "d1", 1), ("q3", "d2", 1), ("q4", "d3", 1)],
                                  "query_id string, doc_id string, relevance int")
    train = spark.createDataFrame([("q0",), ("q1",), ("q2",)], "query_id string")
    return docs, qs, dv, qv, qrels, train


@pytest.mark.parametrize("gamma", [0.0, 0.1, 0.5, 1.3, 2.0])
def test_nudge_n_unit_and_chord(spark, gamma):
    docs, qs, dv, qv, qrels, train = _nudge_fixture(spark)
    tg = N.nudge_targets(qv, qrels, train)
    out = {r.id: np.array(r.vec) for r in N.nudge_n(dv, tg, gamma).collect()}
    for i, d in enumerate(docs):
        v = out[f"d{i}"]
        assert abs(np.linalg.norm(v) - 1) < 1e-9
        assert np.linalg.norm(v - d) <= gamma + 1e-9
        if i > 1 or gamma == 0:
            assert np.allclose(v, d)                                # untouched / gamma 0
    g0 = qs[0] + qs[1]
    u = g0 / np.linalg.norm(g0)
    # no other unit vector within the chord is closer to u
    best = out["d0"] @ u
    rng = np.random.default_rng(5)
    for _ in range(2000):
        cand = docs[0] + rng.normal(size=4) * gamma
        cand /= np.linalg.norm(cand)
        if np.linalg.norm(cand - docs[0]) <= gamma:
            assert cand @ u <= best + 1e-9


def test_nudge_m_formula_and_insert_clash(spark):
    docs, qs, dv, qv, qrels, train = _nudge_fixture(spark)
    tg = N.nudge_targets(qv, qrels, train)
    out = {r.id: np.array(r.vec) for r in N.nudge_m(dv, tg, 0.3).collect()}
    g0 = qs[0] + qs[1]
    assert np.allclose(out["d0"], docs[0] + 0.3 * g0 / np.linalg.norm(g0))
    splits = spark.createDataFrame([("q0", "train", 0)], "query_id string, split string, ord long")
    with pytest.raises(ValueError):
        N.nudge_insert(dv, dv.where("id = 'd0'"), qv, qrels, splits)
    moved = {r.id for r in N.changed_vectors(dv, N.nudge_m(dv, tg, 0.3)).collect()}
    assert moved == {"d0", "d1"}


def test_embedding_stream_fills_store(spark, tmp_path):
    from retrievalkit.streaming import start_embedding_stream

    src = tmp_path / "in"
    schema = "id string, text string"
    spark.createDataFrame([("a", "x y"), ("b", "y z")], schema).write.parquet(str(src / "f1"))
    spark.createDataFrame([("c", "x y"), ("d", "w")], schema).write.parquet(str(src / "f2"))
    q = start_embedding_stream(
        spark, str(src / "*"), spark.createDataFrame([], schema).schema, str(tmp_path / "store"),
        "hash8", embed_fn=lambda df: E.hash_embed(df, 8),
        checkpoint_location=str(tmp_path / "ckpt"), vectors_path=str(tmp_path / "vecs"))
    q.awaitTermination(120)
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.select("text_md5").distinct().count() == 3      # 'x y' stored once
    assert spark.read.parquet(str(tmp_path / "vecs")).count() == 4


def test_store_keeps_null_texts_and_raises_errors(spark, tmp_path):
    fn = lambda df: E.hash_embed(df, 8)
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", ""), ("d", "x y")], "id string, text string")
    store = str(tmp_path / "store")
    for _ in range(2):
        got = {r.id: list(r.vec) for r in E.embed_incremental(docs, store, "m", embed_fn=fn).collect()}
        assert set(got) == {"a", "b", "c", "d"} and got["b"] == got["c"] == [0.0] * 8 and got["a"] == got["d"]
    assert spark.read.parquet(store).count() == 2
    (tmp_path / "broken").write_text("no parquet")
    with pytest.raises(Exception):
        E.embed_incremental(docs, str(tmp_path / "broken"), "m", embed_fn=fn).collect()


@pytest.mark.parametrize("kind", ["nudge-n", "nudge-m"])
def test_one_pass_gamma_equals_a_search_per_gamma(spark, kind):
    """Accuracy of every gamma against tuned vectors searched one by one; a zero
    query counts as a miss, and documents of equal direction tie by id."""
    rng = np.random.default_rng(4)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    D = unit(rng.normal(size=(30, 6))).astype(np.float32)
    D[7] = D[3]
    Q = unit(rng.normal(size=(40, 6))).astype(np.float32)
    Q[39] = 0.0
    vec = "id string, vec array<float>"
    dv = spark.createDataFrame([(f"d{i:02d}", D[i].tolist()) for i in range(30)], vec)
    qv = spark.createDataFrame([(f"q{i:02d}", Q[i].tolist()) for i in range(40)], vec)
    rel = spark.createDataFrame([(f"q{i:02d}", f"d{(i * 7) % 20:02d}", 1) for i in range(40)],
                                "query_id string, doc_id string, relevance int")
    train, val = rel.where("query_id < 'q20'"), rel.where("query_id >= 'q20'")
    targets = N.nudge_targets(qv, rel, train.select("query_id"))
    grid = (0.0, 0.3, 0.8, 1.4, 2.0)
    got = {r.gamma: r for r in N.choose_gamma(dv, targets, qv, val, kind, grid).collect()}
    from retrievalkit.operators.search import knn
    for g in grid:
        tuned = N.apply_nudge(dv, targets, g, kind)
        top = knn(qv.where("id >= 'q20'"), tuned, 1, N.search_metric(kind))
        hits = top.join(val, ["query_id", "doc_id"], "left_semi").count()
        assert got[g].n_queries == 20 and got[g].accuracy == hits / 20, g
    assert sum(r.best for r in got.values()) == 1


@pytest.mark.parametrize("kind", ["nudge-n", "nudge-m"])
def test_gamma_scan_is_bounded_whatever_meets(kind):
    """The scores of all queries with a whole block were held at once."""
    import tracemalloc

    rng = np.random.default_rng(5)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    Q, D, U = unit(1500), unit(4000), unit(4000)
    Q[3], D[7], U[9], D[11] = 0.0, 0.0, D[9], -U[11]
    ids = lambda p, m: np.array([f"{p}{i}" for i in range(len(m))], object)
    out = []
    for cells in (N.SCAN_CELLS, 3001):
        scan = N._GammaScan(ids("q", Q), Q, [0.0, 0.4, 1.0, 2.0], kind, cells)
        tracemalloc.start()
        scan.add(ids("d", D), D, U)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6                           # one matrix of all pairs: 48 MB
        out.append(scan.result())
    assert out[0].equals(out[1]) and out[0].num_rows >= 4 * 1499


@pytest.mark.parametrize("kind", ["nudge-n", "nudge-m"])
def test_bars_fall_as_the_best_document_tells(kind):
    """the scan found every query's best document at every gamma, however many
    ranked before the relevant one. A bar falls where that best document ranks
    before it, and is then left alone."""
    rng = np.random.default_rng(9)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    Q, D, U = unit(300), unit(3000), unit(3000)
    Q[3], D[7], U[9], D[11] = 0.0, 0.0, D[9], -U[11]
    ids = lambda p, m: np.array([f"{p}{i:04d}" for i in range(len(m))], object)
    grid = [0.0, 0.4, 1.0, 2.0]

    def run(bar, moves=True, cells=N.SCAN_CELLS):
        scan = N._GammaScan(ids("q", Q), Q.copy(), grid, kind, cells, bar=bar)
        for a in range(0, 3000, 1000):
            scan.beat(ids("d", D)[a:a + 1000], D[a:a + 1000], U[a:a + 1000] if moves else None)
        return scan

    for moves in (True, False):
        best = N._GammaScan(ids("q", Q), Q, grid, kind)
        best.add(ids("d", D), D, U if moves else D if kind == "nudge-n" else np.zeros_like(D))
        some = best.score > -np.inf
        assert some.sum() >= 4 * 299
        name = best.doc.astype(str).astype(object)
        later, sooner = name + "x", np.full_like(name, "a")
        for change, doc, falls in ((0.0, name, False), (0.0, later, True), (0.0, sooner, False), (-1e-6, sooner, True), (1e-6, later, False)):
            bar = np.full(some.shape, -np.inf)
            bar[some] = _kernel.round_half_up(best.score[some] + change)
            scan = run((bar, doc), moves, N.SCAN_CELLS if falls else 3001)
            fell = {(r["id"], g) for r in scan.lost().to_pylist() for g in r["lost"]}
            assert fell == ({(f"q{q:04d}", g) for g, q in zip(*np.nonzero(some))} if falls else set()), (moves, change, falls)
        low = run((np.where(some, -0.5, -np.inf), sooner), moves)
        assert not low.open.any() and low.looked < 0.05 * len(Q) * len(D) * len(grid)


def test_sums_of_the_move_stand_in_the_plan_once(spark):
    """where a filter reads the moved vectors, as blocks do, the sums of the move
    were put inside its inner functions and computed anew for every element."""
    _, _, dv, qv, qrels, train = _nudge_fixture(spark)
    moved = N.nudge_n(dv, N.nudge_targets(qv, qrels, train), 0.5).where("id is not null and vec is not null and size(vec) > 0")
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 8
