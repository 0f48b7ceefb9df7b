import numpy as np
import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.integers(vocab)}x" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, extra=None):
        ids = range(len(texts)) if ids is None else ids
        df = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)
        return df.repartition(3) if texts else df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeats, non-ASCII, control characters and a very long text."""
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    return [None, "", "   \n\t", "one", "one two", "One TWO three", base, base, base.upper(), "naïve ÉCOLE 日本語 ü x " * 5, "\x00\x01 a\x7f b", words(rng, 60_000, 50_000), base + " tail", "la la la la " * 300]
