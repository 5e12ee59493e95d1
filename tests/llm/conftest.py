import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that the operators use for columns of their own
    *(T.StructField(n, T.StringType()) for n in ("row", "digest", "shared", "kept", "text_hash", "slot", "fingerprint", "score", "base", "k_id", "hit")),
])
LONG = "word " * 40_000 + "x" * 50_000 + " 1" * 20_000


def odd_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    texts = [(1, "plain prose about nothing at all"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG), (None, "a text without an id"),
             (7, "repeated row"), (7, "repeated row"), (8, "same id, one text"), (8, "same id, another text"), (9, "plain prose about  nothing at all"),
             (10, "\x00 control \x1c\x85 and emoji 😀"), (None, None)]
    return [(i, t, None, *["clash"] * 11) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make


def table_rows(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet").collect()
