import pytest

LONG = "Long text with many words, " * 4000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", 1, 0.5),
        (None, "no id at all", "en", 2, 0.1),
        (3, LONG, None, None, None),
        (4, "the same words here again", "en", 3, 0.2),
        (4, "the same words here again", "en", 3, 0.2),
        (5, "the same words here again", "en", 3, 0.2),
        (6, "   \n\t ", "en", 4, 0.3),
        (7, "É×÷ üñí — 漢字 🙂 token: abcdef123456", "de", 5, 0.4),
        (8, "one", "en", 6, 0.4),
    ]
    columns = "doc_id long, text string, lang string, length int, score double"
    frame = spark.createDataFrame(rows, columns)
    for name in ("_text", "_key", "_row", "shard", "slot", "fingerprint", "n_removed", "component_id", "to", "batch"):
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
