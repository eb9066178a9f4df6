import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: (doc_id, text, source): nulls, empty, blank, long, ties, repeated rows.
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "one", "b"), (6, "one two", None),
    (7, "The same text of some words here.\nLine two of it\nLine three", "a"), (8, "The same text of some words here.\nLine two of it\nLine three", "a"),
    (8, "The same text of some words here.\nLine two of it\nLine three", "a"), (None, "The same text of some words here.\nLine two of it\nLine three", "c"), (None, None, None),
    (9, "x\nx\nx\nx\nx", "a"), (10, "Straße ÉCOLE ñandú İz     \x1c 漢字 𝒳", "c"),
    (11, "Licensed under the MIT License, mit license. CC-BY 4.0 GNU General Public License", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """AWKWARD with columns whose names clash with those that operators make."""
    rows = [(i, t, s, "en", 1, 2, "z", 3.0) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long, size int, shard string, score double").repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
