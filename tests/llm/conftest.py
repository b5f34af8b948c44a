import pytest
from pyspark.sql import SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """Documents from (doc_id, text) rows, with a column whose name clashes with ones used inside."""

    def make(rows, **columns):
        full = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or ""), 1) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS + ", row int")

    return make


#: Nulls, empty, blank, short, long, repeated rows, ties.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d"), (6, "word " * 30_000), (7, "same text of five words and more"), (7, "same text of five words and more"), (8, "same text of five words and more"), (None, "no id at all but some words here"), (9, "é ü ñ " * 50)]
