"""Reading raw delimited tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

# Texts read as missing, fixed values.
NA_TOKENS = (
    "", "?", "NA", "nan", "NaN", "-nan", "-NaN", "N/A", "n/a", "#N/A", "#NA", "<NA>", "#N/A N/A", "NULL", "null", "None",
    "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)
SEPARATORS = (",", ";")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The first separator that splits the header into more than one column."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    for sep in SEPARATORS:
        if len(next(csv.reader([header["value"]], delimiter=sep))) > 1:
            return sep
    raise ValueError(f"cannot read {path} with ',' or ';'")


def read_table(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """A CSV with header: separator found, missing tokens NULLed, columns typed as bigint, double or string.

    Without a schema the types are decided by one aggregate over the text values.
    """
    sep = sniff_separator(spark, path)
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        types = dict(part.strip().rsplit(" ", 1) for part in schema.split(","))
        return clean.select(*[F.col(f"`{c}`").try_cast(types.get(c, "string")).alias(c) for c in clean.columns])
    misses = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull())
    row = clean.agg(*[misses(c, k).alias(f"{k}{i}") for i, c in enumerate(clean.columns) for k in ("bigint", "double")]).first()
    kind = lambda i: next((k for k in ("bigint", "double") if row[f"{k}{i}"] == 0), "string")
    return clean.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(clean.columns)])
