import pytest
from hard_rows import ROWS


@pytest.fixture()
def hard(spark):
    """Documents with every hard case, and extra columns with names that operators use."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as long) n_chars", "1 as k", "2 as size", "3 as part", "4 as fp", "5 as n")


@pytest.fixture()
def nothing(hard):
    return hard.limit(0)
