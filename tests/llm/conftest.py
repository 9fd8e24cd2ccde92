import duckdb
import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("row", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fp", T.LongType()), T.StructField("chunk", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def raw(sf):
    """The smallest table's documents, and every odd case: null, empty and blank texts, null ids, repeated rows, a very long text."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    words = [w for r in rows[:20] for w in r[1].split()]
    odd = [
        (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \t\n\x0b\x0c\r ", None, None, 7), (None, "an id that is null", "xx", "s", 18), (9005, "same same same same", "en", "s", 19),
        (9005, "same same same same", "en", "s", 19), (9006, "café \U0001f600 <|endoftext|> é  x y \x1cz don't", "fr", "s", 30), (9007, " ".join(words * 12), "en", "s", None),
        (9008, "x" * 30000, "de", "s", 30000), (9009, "one\ntwo\none\n\n\none\n two", "en", "s", 20),
    ]
    return rows + odd


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame([(*r, "clash", 0.5, 7, 7) for r in raw], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
