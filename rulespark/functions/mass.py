"""Mass-function arithmetic as plain column expressions.

A mass is handled as a Python list of Columns, K class masses followed by omega. K is known when the
plan is built, so every formula unrolls into arithmetic that stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from operator import add

from pyspark.sql import Column, functions as F

from rulespark.functions.arrays import balanced

Vec = list[Column]


def unpack(array: Column, n: int) -> Vec:
    return [F.get(array, F.lit(i)) for i in range(n)]


def total(xs: Sequence[Column]) -> Column:
    return balanced(add, xs)


def divide(xs: Sequence[Column], by: Column) -> Vec:
    return [x / by for x in xs]


def biggest(xs: Sequence[Column]) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def argmax(xs: Sequence[Column]) -> Column:
    """Index of the largest entry, the lowest index on a tie."""
    return (F.array_position(F.array(*xs), biggest(xs)) - 1).cast("int")


def normalise(m: Sequence[Column], eps: float = 1e-8) -> Vec:
    clipped = [F.greatest(x, F.lit(eps)) for x in m]
    return divide(clipped, F.greatest(total(clipped), F.lit(eps)))


def softmax(logits: Sequence[Column]) -> Vec:
    top = biggest(logits)
    raised = [F.exp(x - top) for x in logits]
    return divide(raised, total(raised))


def to_logits(m: Sequence[Column], eps: float = 1e-8, clamp: float = 12.0) -> Vec:
    logs = [F.log(F.greatest(x, F.lit(eps))) for x in m]
    centre = total(logs) / len(logs)
    return [F.least(F.greatest(x - centre, F.lit(-clamp)), F.lit(clamp)) for x in logs]


def _products(a: Vec, b: Vec) -> tuple[Vec, Column, Column]:
    *a_s, a_o = a
    *b_s, b_o = b
    singles = [x * y + x * b_o + a_o * y for x, y in zip(a_s, b_s)]
    agreement = total([x * y for x, y in zip(a_s, b_s)])
    conflict = F.greatest(total(a_s) * total(b_s) - agreement, F.lit(0.0))
    return singles, a_o * b_o, conflict


def dempster_pair(a: Vec, b: Vec, eps: float = 1e-9) -> Vec:
    singles, omega, conflict = _products(a, b)
    kept = 1.0 - F.least(conflict, F.lit(1.0 - eps))
    scaled = divide([*singles, omega], kept)
    return divide(scaled, F.greatest(total(scaled), F.lit(eps)))


def yager_pair(a: Vec, b: Vec) -> Vec:
    singles, omega, conflict = _products(a, b)
    return [*singles, omega + conflict]


def from_log_ratios(logs: Sequence[Column]) -> Vec:
    """Fused Dempster mass from L_k = sum over fired rules of ln(1 + m_k / omega).

    With prod(m_k + omega) = prod(omega) * exp(L_k), the fused singles are proportional to
    exp(L_k) - 1 and omega to 1. Shifting by max(0, L) keeps hundreds of rules inside range.
    """
    shift = F.greatest(F.lit(0.0), *logs)
    floor = F.exp(-shift)
    parts = [F.exp(x - shift) - floor for x in logs] + [floor]
    return divide(parts, total(parts))


def pignistic(m: Sequence[Column]) -> Vec:
    """Omega shared equally among the classes; sums to 1 because the mass does."""
    *singles, omega = m
    return [x + omega / len(singles) for x in singles]


def pignistic_prior(m: Sequence[Column], prior: Sequence[float | Column]) -> Vec:
    *singles, omega = m
    raw = [x + omega * p for x, p in zip(singles, prior)]
    return divide(raw, F.greatest(total(raw), F.lit(1e-12)))


def top2_margin(p: Sequence[Column]) -> Column:
    ranked = F.sort_array(F.array(*p), asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def final_confidence(m: Sequence[Column], prior: Sequence[float | Column]) -> dict[str, Column]:
    p = pignistic_prior(m, prior)
    certainty = 1.0 - m[-1]
    separation = top2_margin(p)
    return {
        "top1": argmax(p),
        "certainty": certainty,
        "separation": separation,
        "final_conf": certainty * F.greatest(separation, F.lit(0.0)),
    }
