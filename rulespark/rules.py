"""The rules table and its driver-side twin.

A rule is an AND of literals (feature, op, value) with op one of `==`, `<`, `>`, an optional class
label and a mass vector over the K classes plus the "don't know" mass in the last place.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

OPS = ("==", "<", ">")
EQ_TOLERANCE = 1e-5
OMEGA_FLOOR = 1e-8

STATS_TYPE = (
    "struct<kind:string,stage:string,support:bigint,neg_covered:bigint,precision:double,"
    "recall:double,f1:double,coverage:double,min_precision:double,pool_score:double>"
)
RULES_SCHEMA = (
    "rule_id bigint, label int, literals array<struct<feature:string,op:string,value:double>>, "
    f"n_literals int, caption string, stats {STATS_TYPE}, mass array<double>"
)
_STATS_FIELDS = (
    "kind", "stage", "support", "neg_covered", "precision", "recall", "f1", "coverage",
    "min_precision", "pool_score",
)


def default_caption(literals: Iterable[tuple]) -> str:
    return " & ".join(f"{f} {op} {v:.6g}" for f, op, v in literals) or "<empty>"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    label: int | None
    literals: tuple[tuple[str, str, float], ...]
    mass: tuple[float, ...] | None = None
    caption: str | None = None
    stats: dict = field(default_factory=dict)

    def __post_init__(self):
        for _, op, _ in self.literals:
            if op not in OPS:
                raise ValueError(f"unsupported operator {op!r}")

    @property
    def safe_mass(self) -> tuple[float, ...]:
        """Mass with every slot at least OMEGA_FLOOR, renormalised, so that m / omega stays finite."""
        raised = [max(float(v), 0.0) for v in self.mass]
        raised[-1] = max(raised[-1], OMEGA_FLOOR)
        total = sum(raised)
        return tuple(v / total for v in raised)


@dataclass(frozen=True)
class RuleSet:
    """Rules held at the driver. Rule tables are bounded by the induction cap, see `collect`."""

    rules: tuple[Rule, ...]
    n_classes: int
    default_label: int = 0
    exact_eq: bool = False  # `==` without tolerance, for codes so large that it would merge neighbours

    def __len__(self) -> int:
        return len(self.rules)

    def __iter__(self):
        return iter(self.rules)

    @property
    def features(self) -> list[str]:
        return sorted({f for r in self.rules for f, _, _ in r.literals})

    @property
    def n_distinct_literals(self) -> int:
        return len({lit for r in self.rules for lit in r.literals})

    def with_masses(self, masses: Sequence[Sequence[float]]) -> "RuleSet":
        fresh = tuple(replace(r, mass=tuple(float(v) for v in m)) for r, m in zip(self.rules, masses))
        return replace(self, rules=fresh)

    @staticmethod
    def collect(rules: DataFrame, n_classes: int, *, default_label: int = 0, limit: int = 20_000) -> "RuleSet":
        """Bring a rules table to the driver. Larger tables stay distributed: `activate_relational`."""
        rows = rules.orderBy("rule_id").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rules; match them with activate_relational")
        return RuleSet(
            tuple(
                Rule(
                    rule_id=r["rule_id"],
                    label=r["label"],
                    literals=tuple((x["feature"], x["op"], x["value"]) for x in r["literals"]),
                    mass=tuple(r["mass"]) if r["mass"] is not None else None,
                    caption=r["caption"],
                    stats=r["stats"].asDict() if r["stats"] is not None else {},
                )
                for r in rows
            ),
            n_classes,
            default_label,
        )


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (
            r.rule_id,
            r.label,
            [tuple((f, op, float(v))) for f, op, v in r.literals],
            len(r.literals),
            r.caption or default_caption(r.literals),
            tuple(r.stats.get(k) for k in _STATS_FIELDS),
            [float(v) for v in r.mass] if r.mass is not None else None,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def literals_of(rules: DataFrame) -> DataFrame:
    """One row per literal: (rule_id, pos, feature, op, value)."""
    return rules.select("rule_id", F.posexplode("literals").alias("pos", "lit")).select(
        "rule_id", "pos", "lit.feature", "lit.op", "lit.value"
    )
