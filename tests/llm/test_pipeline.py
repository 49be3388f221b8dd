import corpus_pipeline as P
from retrievalkit.llm import queries as Q
from retrievalkit.llm._spark import stored
from tests.conftest import SF001, SF01
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import brute as groups
from tests.llm.test_secret_scan import base
from tests.oracle import compare


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    cols = docs.dtypes
    clean = stored(P.toxicity(spark, docs, SF001), "t")
    assert 0 < clean.count() < docs.count() and clean.dtypes == cols
    one = stored(P.near_dedup(spark, clean, SF001), "d")
    found = groups(rows(clean), 5, 80)
    assert sorted(d for d, _ in rows(one)) == sorted(set(found.values())) and one.dtypes == cols
    free = stored(P.decontaminate(spark, one, SF001), "c")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks(rows(one), items)}
    assert {d for d, _ in rows(free)} == {d for d, _ in rows(one)} - bad and free.dtypes == cols
    masked = stored(P.mask_secrets(spark, free, SF001), "m")
    before, after = dict(rows(free)), dict(rows(masked))
    assert before.keys() == after.keys() and masked.dtypes == cols
    assert all(("[SECRET]" in after[d]) >= bool(base(t)) for d, t in before.items())
    packed = P.packing(spark, masked, SF001)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    total = packed.groupBy("doc_id").agg({"length": "sum"}).count()
    assert total == masked.count()
    assert P.run(spark, SF001).count() == packed.count()


def test_messy_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "other words", None, None, None),
         (2, None, None, "s", None), (None, "x y", None, None, 3), (None, None, None, None, None), (3, "", "en", "s", 0),
         (4, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF001), name)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "2", "3", "None", "None"]
    assert P.packing(spark, docs, SF001).filter("start = 0").count() == 6
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty_out = stage(spark, empty, SF001)
        assert empty_out.count() == 0


def test_near_dedup_loses_only_copies(spark, messy):
    """Every column, clashing names and maps; unlike rows of one id stay."""
    whole = messy.selectExpr("*", "map('k', n) as m", "1 as key", "2 as n_chars")
    out = stored(P.near_dedup(spark, whole, SF001), "d")
    assert out.columns == whole.columns
    groups_ = [tuple(r) for r in out.select("doc_id", "text").collect()]
    texts = [(r["doc_id"], r["text"]) for r in messy.collect()]
    # 1 twice and 2 are copies, 9 is one of 8; rows without an id stay
    assert sorted(map(repr, groups_)) == sorted(map(repr, [t for n, t in enumerate(texts) if n not in (1, 2, 11)]))
    rows_ = [(1, "one two three four five six"), (1, "quite another text under the same id here"), (2, "Quite another text under the same id here"),
             (0, "one two three four five six"), (3, None), (3, ""), (3, "x"), (1, "one two three four five six")]
    got = rows(P.near_dedup(spark, spark.createDataFrame(rows_, "doc_id long, text string"), SF001))
    assert sorted(map(repr, got)) == sorted(map(repr, [rows_[1], rows_[3], (3, "x")] + [r for r in got if not r[1]]))
    assert sum(not t for _, t in got) == 1


def test_registered_queries(spark, con01):
    import __spark_entry__ as E

    names = sorted(n for n in E.queries() if n.startswith("op"))
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in E.queries()
    for name, sql in Q.ORACLES.items():
        compare(Q.QUERIES[name](spark, SF01), con01, sql)
