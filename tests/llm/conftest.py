import pytest

from tests.conftest import SF001


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, blank and long texts, repeated rows, and columns
    whose names clash with those the operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, None), (4, ""),
            (5, " \t\n "), (6, "one"), (7, "one two"), (None, "a b c d e f g h i j"), (None, None), (8, long),
            (9, long + " tail"), (10, "naïve Ünï ²½ 🙂 <|endoftext|> x\x1cy"), (11, "token = abcdef123456")]
    return spark.createDataFrame(
        [(d, t, None, None if i % 2 else i, "x", None, i, None) for i, (d, t) in enumerate(rows)],
        "doc_id long, text string, id string, n long, spans string, component double, row int, shard string")


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def texts001(docs001):
    return {r["doc_id"]: r["text"] for r in docs001.select("doc_id", "text").collect()}
