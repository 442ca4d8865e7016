"""Paired tests with planted ties, zeros and small samples against direct enumeration."""

import itertools
import math
import random

import pytest

from rulespark.operators import experiments as E


def plain(deltas, higher_is_better=True):
    """(w_plus, n_used, p): exact by trying all signs, or the normal tail with tie correction."""
    signed = [d if higher_is_better else -d for d in deltas if d]
    sizes = sorted(abs(d) for d in signed)
    rank = {s: sum(i + 1 for i, x in enumerate(sizes) if x == s) / sizes.count(s) for s in set(sizes)}
    w, n = sum(rank[abs(d)] for d in signed if d > 0), len(signed)
    if len(deltas) < 5 or not signed:
        return w, n, None
    ties = [sizes.count(s) for s in set(sizes)]
    if n == len(deltas) and max(ties) == 1:
        hits = sum(sum(r for r, up in zip(range(1, n + 1), ups) if up) >= w for ups in itertools.product((0, 1), repeat=n))
        return w, n, hits / 2**n
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    return w, n, 0.5 * math.erfc((w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


CASES = {
    "distinct": [0.1, -0.2, 0.3, 0.4, -0.5, 0.6, 0.7],
    "ties": [0.1, 0.1, -0.1, 0.3, 0.3, -0.2, 0.25, 0.1],
    "zeros": [0.0, 0.5, -0.25, 0.125, 0.0, 0.75, -0.5],
    "ties and zeros": [0.0, 0.5, 0.5, -0.5, 0.0, 0.25, 0.25, -0.25, 1.0],
    "few": [0.1, 0.2, -0.3],
    "only zeros": [0.0] * 6,
    "random": [round(random.Random(3).uniform(-1, 2), 1) for _ in range(40)],
}


@pytest.mark.parametrize("metric", ["acc", "nll"])
def test_significance_with_ties_and_zeros(spark, metric):
    rows = [(name, metric, "a", "b", d) for name, deltas in CASES.items() for d in deltas]
    df = spark.createDataFrame(rows, "case string, metric string, left string, right string, delta double")
    got = {r["case"]: r for r in E.significance(df, ["case", "metric", "left", "right"]).collect()}
    for name, deltas in CASES.items():
        w, n, p = plain(deltas, metric == "acc")
        r = got[name]
        assert (r["n_used"] or 0, r["w_plus"] or 0.0) == (n, w), name
        assert (r["p_value"] is None) == (p is None) and (p is None or abs(r["p_value"] - p) < 1e-12), name
        assert (r["n"], r["wins"], r["losses"]) == (len(deltas), sum(d > 0 for d in deltas), sum(d < 0 for d in deltas))
