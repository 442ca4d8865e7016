"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokens. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.llm import exact_dedup, mixing, simhash, toxicity
from rulespark.llm.common import documents, stored, taken_name
from rulespark.llm.queries import token_digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = taken_name(docs, "score")[0]
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = taken_name(docs, "size")[0]
    mixed = mixing.mix(docs.withColumn(size, mixing.n_words(F.col("text"))), size=size)
    return mixing.emit(mixed).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenize),
]

# The first stage is a trained model and the last a tokenizer: SQL cannot express them. tests/llm compares the stages with
# plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
