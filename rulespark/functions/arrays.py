"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def balanced(join: Callable, items: Sequence):
    """Combine many expressions pairwise, so that the expression tree stays shallow."""
    items = list(items)
    while len(items) > 1:
        items = [join(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def unnest(df: DataFrame, keep: list, items: Column | str, name: str) -> DataFrame:
    """One row per array entry.

    A plain explode lets the optimizer add a size filter and push it below the projection that built
    the array, evaluating (and inlining) that expression a second time. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
