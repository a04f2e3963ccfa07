import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="session")
def small(spark):
    """The tables of the smallest scale."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def larger(spark):
    """The tables of the next scale, for what needs examples."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


@pytest.fixture(scope="session")
def small_docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")


def make_docs(spark, texts, **columns):
    """Documents from (doc_id, text) pairs."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({k: F.lit(v) for k, v in columns.items()})


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeats, clashing names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    texts = [
        (1, "One two three four five six."),
        (1, "One two three four five six."),
        (1, "Another text of the same id."),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, long),
        (None, "A text without an id, which is kept."),
        (None, None),
        (6, "12 34 !!"),
        (7, "One two three four five six."),
    ]
    docs = make_docs(spark, texts)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") != 7, F.col("lang")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") != 4, F.col("source")))
    clash = ("score", "size", "keys", "mark", "line", "tag", "p", "x", "n", "bucket", "part", "rank")
    return docs.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0), (7, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def ids(frame, column="doc_id"):
    return sorted((r[column] for r in frame.collect()), key=lambda i: (i is not None, i))
