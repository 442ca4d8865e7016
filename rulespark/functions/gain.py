"""Scores used by rule induction, as column expressions over aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def foil_gain(p0: Column, n0: Column, p1: Column, n1: Column) -> Column:
    def purity(p: Column, n: Column) -> Column:
        return F.log((p + 1e-9) / (p + n + 1e-9))

    return F.when(p1 < 1, F.lit(float("-inf"))).otherwise(p1 * (purity(p1, n1) - purity(p0, n0)))


def gini(p: Column) -> Column:
    return 1.0 - p * p - (1.0 - p) * (1.0 - p)


def gini_gain(left_n: Column, left_pos: Column, n: Column, pos: Column) -> Column:
    right_n = n - left_n
    right_pos = pos - left_pos
    left = gini(left_pos / F.nullif(left_n, F.lit(0)))
    right = gini(right_pos / F.nullif(right_n, F.lit(0)))
    return gini(pos / n) - (left_n / n * left + right_n / n * right)


def prune_score(p: Column, n: Column, all_pos: Column, all_neg: Column) -> Column:
    """Accuracy on the prune set plus a thousandth of the Laplace precision; NULL when nothing is covered."""
    size = F.greatest(all_pos + all_neg, F.lit(1))
    accuracy = (p + (all_neg - n)) / size
    laplace = (p + 1.0) / (p + n + 2.0)
    return F.when(p + n > 0, accuracy + 1e-3 * laplace)


def vote_strength(support: Column, neg: Column, n_classes: int, alpha: float = 1.0) -> Column:
    quality = (support + alpha) / (support + neg + alpha * n_classes)
    return quality * F.log1p(F.greatest(support, F.lit(0)).cast("double"))
