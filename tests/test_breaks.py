"""Natural breaks against all partitions of small tables, and their coarse form against the exact one."""

import itertools
import random

import numpy as np
import pytest

from rulespark.operators import breaks as B, prepare as P


def cost(values, weights, ends):
    total, start = 0.0, 0
    for e in ends:
        v, w = values[start : e + 1], weights[start : e + 1]
        total += (w * (v - (v * w).sum() / w.sum()) ** 2).sum()
        start = e + 1
    return total


@pytest.mark.parametrize("seed", range(30))
def test_least_cost_of_all_partitions(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 12)), int(rng.integers(1, 6))
    values, weights = np.unique(rng.normal(1e6, 3, n).round(1)), None
    weights = rng.integers(1, 9, len(values))
    got = B.best_ranges(values, weights, k)
    ways = [(*c, len(values) - 1) for c in itertools.combinations(range(len(values) - 1), min(k, len(values)) - 1)]
    assert len(got) == min(k, len(values)) and got[-1] == len(values) - 1
    assert cost(values, weights, got) <= min(cost(values, weights, w) for w in ways) + 1e-7


def plain_thresholds(xs, k):
    values, weights = np.unique(xs, return_counts=True)
    return values[B.best_ranges(values, weights, k)].tolist()


@pytest.mark.parametrize("kind", ["normal", "lumps", "skew"])
def test_many_values_by_buckets(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    xs = {"normal": rng.normal(0, 10, 4000), "lumps": rng.normal(rng.choice([0, 5, 50], 4000), 1), "skew": rng.exponential(3, 4000) ** 2}[kind].round(2)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(4)
    want = plain_thresholds(xs, 4)
    assert B.break_values(df, "x", 4) == want
    monkeypatch.setattr(B, "VALUES", 10)
    monkeypatch.setattr(B, "BUCKETS", 64)
    assert B.break_values(df, "x", 4) == want


def test_thresholds_are_nearest_to_their_own_mean(spark, sf_dir="/root/testdata/sf0.001"):
    prices = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tops = [r["threshold"] for r in P.natural_breaks(prices, "o_totalprice").orderBy("pos").collect()]
    xs = np.sort([r[0] for r in prices.select("o_totalprice").collect()]).astype(float)
    place = np.searchsorted(tops, xs)
    means = np.array([xs[place == i].mean() for i in range(5)])
    assert (np.abs(xs[:, None] - means).argmin(axis=1) == place).all()


def test_few_null_and_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    assert [tuple(r) for r in P.natural_breaks(df, "x", k=5).collect()] == [(0, 1.0), (1, 3.0)]
    assert [r.threshold for r in P.natural_breaks(df, "x", k=5, append_infinity=True).collect()] == [1.0, float("inf")]
    assert P.natural_breaks(df.limit(0), "x").count() == 0
