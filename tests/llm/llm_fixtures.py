import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if clash:
            for name in ("n_tokens", "bucket", "block", "score", "node", "_id", "payload", "item_id", "kept", "same"):
                df = df.selectExpr("*", f"1 AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, repeated rows, odd characters, one long text."""
    return [
        (1, "The quick brown fox jumps over the lazy dog, it's 3 o'clock."), (2, None), (3, ""), (4, "   \n\t "), (None, "a row without an id"),
        (5, "The quick brown fox jumps over the lazy dog, it's 3 o'clock."), (5, "The quick brown fox jumps over the lazy dog, it's 3 o'clock."),
        (6, "naïve café ß 漢字 かな 한글 \U0001f600 ²³ ½   \x1c x\x85y  z ɐ ֋ ԰"), (7, "<|endoftext|> inside <|endoftext|>"),
        (8, "word " * 40_000), (9, "x" * 3_000), (10, "lorem ipsum dolor sit amet " * 300), (11, "don't we'll I'm 'sup 12345 !!! ___"),
    ]
