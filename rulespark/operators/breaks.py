"""Natural breaks: the one-dimensional k-means of least cost, from counts of values.

Sorted values make every cluster a range, so the best k ranges follow from dynamic programming over value counts: the best
start of a cluster moves right with its end, and halving finds all starts of a layer in n log n steps. Counts are summed in
the cluster; up to VALUES different ones come to the driver. Beyond that, buckets between approximate quantiles stand for
their values, and buckets around the breaks found are opened until every break lies between two single values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VALUES = 500_000
BUCKETS = 2_048


def best_ranges(values: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Index of the last value of each of the k ranges of least weighted squared distance to their means; values ascend."""
    n = len(values)
    if n <= k:
        return list(range(n))
    weights = weights.astype(float)
    x = values - (values * weights).sum() / weights.sum()  # small numbers: less is lost when squares are subtracted
    zero = lambda a: np.concatenate(([0.0], np.cumsum(a)))
    count, first, second = zero(weights), zero(weights * x), zero(weights * x * x)

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the range from i to j, both included."""
        s = first[j + 1] - first[i]
        return np.maximum(second[j + 1] - second[i] - s * s / (count[j + 1] - count[i]), 0.0)

    ends = np.arange(n)
    best, starts = cost(np.zeros(n, int), ends), []
    for layer in range(1, k):
        total, start = np.full(n, np.inf), np.zeros(n, int)
        low, high = np.array([layer]), np.array([n - 1])  # ends that are open, with where their starts may lie
        left, right = np.array([layer]), np.array([n - 1])
        while len(low):
            mid = (low + high) // 2
            size = np.minimum(right, mid) - left + 1
            at = np.repeat(np.arange(len(mid)), size)
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + left[at]
            sums = best[i - 1] + cost(i, mid[at])
            least = np.minimum.reduceat(sums, np.cumsum(size) - size)
            hit = np.flatnonzero(sums == least[at])
            chosen = i[hit[np.unique(at[hit], return_index=True)[1]]]  # the first on a tie
            total[mid], start[mid] = least, chosen
            parts = [(low, mid - 1, left, chosen), (mid + 1, high, chosen, right)]
            low, high, left, right = (np.concatenate(c) for c in zip(*[[c[p[0] <= p[1]] for c in p] for p in parts]))
        best = total
        starts.append(start)
    out = [n - 1]
    for start in reversed(starts):
        out.append(int(start[out[-1]]) - 1)
    return out[::-1]


def _atoms(rows: DataFrame, cuts: np.ndarray, opened: set[int] | None) -> pa.Table:
    """(bucket, value, n, total, top) by value: single values of opened buckets (None: of all), one row for each other bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open = np.ones(len(cuts) + 1, bool) if opened is None else np.isin(np.arange(len(cuts) + 1), list(opened))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(cuts, x)
            single = is_open[bucket]
            value, n = np.unique(x[single], return_counts=True)
            own = np.searchsorted(cuts, value)
            shut, at, m = np.unique(bucket[~single], return_inverse=True, return_counts=True)
            top = np.full(len(shut), -np.inf)
            np.maximum.at(top, at, x[~single])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, shut])), pa.array(np.concatenate([value, np.zeros(len(shut))]), mask=np.arange(len(value) + len(shut)) >= len(value)),
                    pa.array(np.concatenate([n, m])), pa.array(np.concatenate([value * n, np.bincount(at, weights=x[~single], minlength=len(shut))])),
                    pa.array(np.concatenate([value, top])),
                ],
                names=["bucket", "value", "n", "total", "top"],
            )

    found = rows.mapInArrow(count, "bucket long, value double, n long, total double, top double")
    return found.groupBy("bucket", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top")).orderBy("top").toArrow()


def break_values(df: DataFrame, column: str, k: int) -> list[float]:
    """The largest value of each cluster, ascending; as many as there are different finite values if those are fewer than k."""
    x = F.col(column).cast("double")
    rows = df.select((x + F.lit(0.0)).alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    row = rows.agg(F.approx_count_distinct("x"), F.percentile_approx("x", [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS)).first()
    opened: set[int] | None = None if row[0] <= VALUES else set()
    cuts = np.unique(np.array(row[1] or [], float)) if opened is not None else np.empty(0)
    while True:
        atoms = _atoms(rows, cuts, opened)
        n, top = atoms["n"].to_numpy(), atoms["top"].to_numpy()
        value = np.where(atoms["value"].is_null().to_numpy(), atoms["total"].to_numpy() / np.maximum(n, 1), top)
        ends = best_ranges(value, n, k)
        if opened is None:
            return top[ends].tolist()
        bucket = atoms["bucket"].to_numpy()
        beside = {int(bucket[i]) for e in ends[:-1] for i in (e, e + 1)}
        if beside <= opened:
            return top[ends].tolist()
        opened |= {b + d for b in beside for d in (-1, 0, 1)}
