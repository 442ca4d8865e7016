"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespark.session import scratch_path

# Words are runs of anything but ASCII white space; the same class in Java, RE2 and Python's bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a fresh folder beside the shared checkpoints and read again.

    Cuts the lineage so that a lost executor costs one task, not the loop so far, and gives the planner real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written like `stored`, in as many buckets of `key` as a shuffle has partitions, and read again.

    No row moves for it, and a later grouping by `key` reads the buckets instead of shuffling.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "stored_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII takes the fast built-in, which then does the same."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def taken_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of df, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
