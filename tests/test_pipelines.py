"""The end-to-end entry points with the Python stand-in encoder (E1 hook)."""

from pyspark.sql import functions as F

from retrievalkit.operators.embed import hashing_encoder_factory
from retrievalkit.plans import pipelines as P
from retrievalkit.plans import text_eval as TX
from retrievalkit.sources import testdata
from tests.conftest import SF01


def test_evaluate_model_equals_jvm_text_path(spark, tmp_path):
    t = TX.dataset(spark, SF01)
    enc = hashing_encoder_factory(TX.DIM)
    got = P.evaluate_model(t, enc, "val", query_instruction=TX.QUERY_INSTRUCTION,
                           run_id="hash64").first().asDict()
    want = TX.run_benchmark(t, "val").first().asDict()
    assert got == want
    stored = P.evaluate_model(t, enc, "val", query_instruction=TX.QUERY_INSTRUCTION,
                              run_id="hash64", store_path=str(tmp_path / "store"),
                              model_name="hash64").first().asDict()
    assert stored == want


def test_mining_rows_synthesis_and_tuning(spark):
    t = TX.dataset(spark, SF01)
    enc = hashing_encoder_factory(TX.DIM)
    mined = P.mine_and_replace(t, enc, "train", n=15)
    train = t.splits.where("split = 'train'").select("query_id")
    negs = (mined.qrels.where("relevance = 0").join(train, "query_id", "left_semi")
            .groupBy("query_id").count())
    assert negs.count() == train.count()
    assert negs.agg(F.min("count"), F.max("count")).first() == (15, 15)
    rows, cols, skipped = P.make_training_rows(mined, "train", 3)
    assert cols == ["query", "pos", "neg_0", "neg_1", "neg_2"] and rows.count() > 0
    prompts = P.synthesis_prompts(t, 5)
    assert prompts.count() == 5
    back = P.synthesize(t, testdata.qa_responses(spark, SF01).select("corpus_id", "response"))
    assert back.splits.where("split = 'train'").count() > t.splits.where("split = 'train'").count()
    metrics, tuned, gamma = P.tune_and_evaluate(t, enc, grid=(0.0, 0.5))
    assert gamma in (0.0, 0.5) and tuned.count() == t.corpus.count()
    assert metrics.first()["n_run_queries"] > 0


def test_every_text_meets_the_encoder_once(spark, tmp_path):
    """The vectors of a corpus are read by several branches of each entry point
    but encoded once; a store spares the next call altogether."""
    t = TX.dataset(spark, SF01)
    n_corpus, n_all = t.corpus.count(), t.queries.count()
    n = {s: t.splits.where(F.col("split") == s).count() for s in ("train", "val")}
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def __init__(self):
            self.inner = hashing_encoder_factory(TX.DIM)()

        def __call__(self, texts):
            seen.add(len(texts))
            return self.inner(texts)

    def calls(run):
        seen.value = 0
        run()
        return seen.value

    assert calls(lambda: P.evaluate_model(t, Counting, "val").collect()) == n_corpus + n["val"]
    assert calls(lambda: P.mine_and_replace(t, Counting, "train", n=15).qrels.collect()) == n_corpus + n["train"]
    assert calls(lambda: P.tune_and_evaluate(t, Counting, grid=(0.0, 0.5))[0].collect()) == n_corpus + n_all
    store = str(tmp_path / "vectors")
    evaluate = lambda: P.evaluate_model(t, Counting, "val", store_path=store, model_name="m").collect()
    assert calls(evaluate) == n_corpus + n["val"] and calls(evaluate) == 0
