import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("key", T.StringType()), T.StructField("cid", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("h", T.LongType())])


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "k", 1, 2, 3)


def awkward():
    """Nulls, empty, blank and very long texts, ties, repeated rows, odd symbols."""
    r = random.Random(4)
    words = "alpha beta gamma delta the of and idiot zeta Eta THETA iota".split()
    long = " ".join(r.choice(words) + str(r.randint(0, 50)) for _ in range(30_000))
    texts = [None, "", "   \n\t", "one", "It's 12 o'clock\nÉté ÉTÉ <|endoftext|> naïve \U0001f600", "日本語 テキスト Σας ΣΑΣ", long, "a\nb\nc", "\x00\x1c \x85  "]
    base = " ".join(r.choice(words) + str(r.randint(0, 9)) for _ in range(120))
    texts += [base, base, base + " tail", base.upper()] + [" ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.randint(1, 60))) for _ in range(12)]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], doc(None, "null id here"), doc(None, None), (7001, "only text", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
