"""Rule literals and rules as boolean columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from rulespark.rules import EQ_TOLERANCE


def holds(x: Column, op: str, value: float | Column, *, exact_eq: bool = False) -> Column:
    """Truth of one literal. NaN satisfies nothing, although Spark sorts NaN above every number."""
    v = value if isinstance(value, Column) else F.lit(float(value))
    if op == "<":
        return x < v
    if op == ">":
        return (x > v) & ~F.isnan(x)
    if op == "==":
        if exact_eq:
            return x == v
        return F.abs(x - v) <= EQ_TOLERANCE + EQ_TOLERANCE * F.abs(v)
    raise ValueError(f"unsupported operator {op!r}")


def rule_holds(literals: Iterable[tuple[str, str, float]], *, exact_eq: bool = False) -> Column:
    tests = [holds(F.col(f).cast("double"), op, v, exact_eq=exact_eq) for f, op, v in literals]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def holds_dynamic(x: Column, op: Column, value: Column, *, exact_eq: bool = False) -> Column:
    """The same test where operator and value come from a literal table."""
    equal = (x == value) if exact_eq else F.abs(x - value) <= EQ_TOLERANCE + EQ_TOLERANCE * F.abs(value)
    return F.when(op == "<", x < value).when(op == ">", (x > value) & ~F.isnan(x)).when(op == "==", equal & ~F.isnan(x))
