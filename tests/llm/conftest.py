import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


ODD_TEXTS = [
    None, "", " \t\n ", "one", "One two", "a b c", "A B C", "a  b\tc", "a b c", "é É ß \U0001f600  x y", "x" * 60_000,
    "word " * 30_000, "'s 'S don't  stop\n\n\n  now 12345 +-*/ ___", "\x00\x1c\x1f\x85 ﻿",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, ["en", None][i % 2], ["s", None, "t"][i % 3], "x", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a b c", "en", "s", "y", None), (3, "one", "en", "s", "y", 2), (3, "one", "en", "s", "y", 2), (99, "A b C", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, sha string, key int"
    return spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
