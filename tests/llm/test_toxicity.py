import numpy as np

from retrievalkit.llm import toxicity as X
from tests.conftest import SF001

SF1 = "/root/testdata/sf0.1"


def weight(matcher, text):
    return sum(w for *_, w in matcher.matches(text)[0])


def test_grammar_scopes():
    m = X.Matcher({"idiot": 4.0, "kill": 3.0, "vequ*": 2.0})
    plain, aimed = weight(m, "the idiot came"), weight(m, "you idiot")
    assert plain == 4.0 and aimed > plain
    assert weight(m, "he is not an idiot") < plain < aimed
    assert weight(m, "the report was. he said that this is an idiot") < aimed
    assert weight(m, "she said stop. an idiot came") == plain          # scope ends with the clause
    assert weight(m, "a threat to kill time") == 0                     # no target
    assert weight(m, "i will kill you") > 0 and weight(m, "kill. you") == 0
    assert weight(m, "vequté!") == 2.0 and weight(m, "vaquer") == 0
    assert m.matches("") == ([], 0)


def test_composition_equals_running_in_turn():
    a, b = X._scope(X.NEGATION, 3, "n"), X._scope(X.REPORT, None, "r")
    both = X.compose(a, b, [(k, ()) for k in range(7)])
    r = np.random.default_rng(1)
    for _ in range(50):
        p, q, s = a.start, b.start, both.start
        for k in r.integers(0, 7, 30).tolist():
            p, mid = a.read(p, (k, ()))
            q, out = b.read(q, mid)
            s, got = both.read(s, (k, ()))
            assert got == out


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    held = labels.filter("crc32(cast(doc_id as string)) % 5 = 0")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    model = X.fit(docs, labels)
    assert model.weights == X.fit(docs, flipped).weights                # held-out labels are never seen
    rows = X.toxicity(docs, model).join(held, held["doc_id"] == X.F.col("id")).select("score", "toxic").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert auc > 0.85 and ((s >= 0.5) & (y == 0)).sum() <= 0.01 * (y == 0).sum()
    assert (0 <= s).all() and (s <= 1).all()


def test_messy_empty_and_no_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(messy, none)
    got = X.toxicity(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert X.toxicity(messy.limit(0), model).count() == 0
    assert X.not_toxic(messy, model).columns == messy.columns
    bad = spark.createDataFrame([(1, "you worthless idiot, you are scum!"), (2, "a kind word")], "doc_id long, text string")
    assert [r["doc_id"] for r in X.not_toxic(bad, model).collect()] == [2]
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 7)], "doc_id long, toxic int")
    assert X.fit(messy, odd).coef.shape == (X.FEATURES + 1,)


def test_registered_query(spark):
    from retrievalkit.llm.queries import QUERIES

    rows = QUERIES["op3_toxicity"](spark, SF001).collect()
    assert len(rows) == 200 and all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
