"""Benchmark run files and hard-case exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.operators.experiments import with_method
from rulespark.sources.tables import read_table


def collect_runs(spark: SparkSession, paths: Sequence[str], datasets: Sequence[str] = (), *, order: Sequence[str] = ("split_seed", "pool_shaping")) -> DataFrame:
    """Union of run files with whatever columns each has, method names unified, one run per (dataset, method, seed).

    Of several runs the first by `order` stays; the choice combines map-side.
    """
    frames = [read_table(spark, p) for p in paths]
    runs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "split_seed" not in runs.columns:
        runs = runs.withColumn("split_seed", F.col("seed"))
    if "pool_shaping" not in runs.columns:
        runs = runs.withColumn("pool_shaping", F.lit(None).cast("boolean"))
    runs = with_method(runs.withColumn("pool_shaping", F.lower(F.col("pool_shaping").cast("string")).try_cast("boolean")))
    if datasets:
        runs = runs.where(F.col("dataset").isin(*datasets))
    first = F.min_by(F.struct(*runs.columns), F.struct(*order))
    return runs.groupBy("dataset", "method", "seed").agg(first.alias("r")).select("r.*")


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.partitionBy("dataset").parquet(path)


def export_hard_cases(base: DataFrame, path: str, key: Sequence[str]) -> None:
    """One folder per (dataset, algo), sorted by key: one file, or where it is too large for a task several whose ranges follow each other."""
    order = ["dataset", "algo", *key]
    base.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("dataset", "algo").parquet(path)
