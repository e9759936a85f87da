import pytest
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: documents with columns that clash with the operators' own names.
DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
    StructField("score", DoubleType()), StructField("kept", BooleanType()), StructField("component_id", LongType()), StructField("fp", LongType()), StructField("size", LongType()), StructField("t", StringType()), StructField("i", LongType()),
])


def words(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.fixture()
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])."""
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, 0.5, True, 7, 8, 9, "x", 1) for r in rows], DOCS)

    return make


@pytest.fixture()
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and very long texts, repeated ids and rows."""
    long = words(40_000, 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, long), (None, "null id here"), (None, None, None, None), (8, words(30, 2), None, "z"), (9, words(30, 3), "fr", None), (8, words(30, 2), None, "z"), (8, words(31, 4)), (10, "日本語 のテスト é\x00x"), (11, "a" * 5000)]
    return make_docs(rows)
