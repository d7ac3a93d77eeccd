import pytest

EDGE = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "   \n\t ", None, None, None), (4, "Hello", "en", "s", 5),
    (5, "HELLO", "en", "s", 5), (5, "HELLO", "en", "s", 5), (None, "hello", None, None, None), (None, None, None, None, None),
    (6, "ÀÉ élève ΑΣ ǅ İstanbul", "fr", "s", 3), (7, "àé élève ας ǆ i̇stanbul", "fr", "s", 3), (8, "ÀÉ ÉLÈVE ΑΣ ǅ İSTANBUL", "fr", "s", 3),
    (9, "a <|endoftext|> b's  don't\n\n 12345 ...  x\x85y\x1cz 漢字 🙂🙂 aaaaaaa", "en", "s", 1),
    (10, "word " * 30000, "en", "s", 1), (11, "the cat sat on the mat and the dog sat on the log " * 40, "en", "s", 1),
    (12, "The cat sat on the mat and the dog sat on the log " * 40, "en", "s", 1),
    (13, "x" * 5000, "en", "s", 1), (14, "Hello", "en", "s", 5),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = ["kept", "fingerprint", "component_id", "group_size", "score", "spans", "verdict", "length", "n", "a", "b", "u", "v", "block", "fp"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, other scripts, clashing extra columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, COLUMNS).repartition(3).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    from ..conftest import MEDIUM

    return spark.read.parquet(f"{MEDIUM}/documents.parquet")


@pytest.fixture(scope="session")
def every(documents, edge):
    """The documents of sf0.01 and the edge rows."""
    cols = documents.columns
    return documents.unionByName(edge.select(cols))
