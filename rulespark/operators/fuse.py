"""Fusing the masses of the fired rules into class beliefs and an explicit "don't know" mass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulespark.functions import mass as M
from rulespark.functions.arrays import balanced
from rulespark.operators.activate import batch_matrix, choose_form, rule_flags, with_fired
from rulespark.rules import OMEGA_FLOOR, RuleSet
from rulespark.session import small_side


# Rules matched before their sums are added up, to bound the memory of one Arrow batch.
RULES_PER_BLOCK = 128


def log_ratios(rule) -> list[float]:
    *singles, omega = rule.safe_mass
    return [float(np.log1p(m / omega)) for m in singles]


def label_table(rules: RuleSet, value=lambda r: 1.0) -> list[list[float]]:
    """R x K table with value(rule) in the column of the rule's label."""
    return [[float(value(r)) if r.label == c else 0.0 for c in range(rules.n_classes)] for r in rules]


def evidence_tables(rules: RuleSet) -> dict[str, list[list[float]]]:
    return {"votes": label_table(rules), "log_ratio": [log_ratios(r) for r in rules]}


def _sum_when(flags: Sequence[Column], values: Sequence[float]) -> Column:
    terms = [F.when(flag, F.lit(float(v))).otherwise(F.lit(0.0)) for flag, v in zip(flags, values) if v]
    return balanced(add, terms or [F.lit(0.0)])


def with_evidence(
    df: DataFrame, rules: RuleSet, *, extra: dict[str, list[list[float]]] | None = None, form: str | None = None
) -> DataFrame:
    """df plus one `evidence` struct per row: everything every fusion rule but Yager needs, row-local.

    Each field is a sum of per-rule constants over the fired rules: their number, their omegas, their
    votes per class and L_k = sum ln(1 + m_k / omega), which is all Dempster's rule needs however many
    rules fire. `extra` adds further R x width tables summed the same way. No grouping or shuffle.
    """
    tables = {**evidence_tables(rules), **(extra or {})}
    omegas = [r.safe_mass[-1] for r in rules]
    if (form or choose_form(rules)) == "batches":
        return _evidence_batches(df, rules, omegas, tables)
    flags = rule_flags(rules)
    firsts = [F.when(flag, F.lit(r.label)) for r, flag in zip(rules, flags) if r.label is not None]
    arrays = [
        F.array(*[_sum_when(flags, [row[c] for row in table]) for c in range(len(table[0]))]).alias(name)
        for name, table in tables.items()
    ]
    return df.withColumn(
        "evidence",
        F.struct(
            _sum_when(flags, [1.0] * len(flags)).cast("int").alias("n_fired"),
            _sum_when(flags, omegas).alias("sum_omega"),
            (F.coalesce(*firsts) if firsts else F.lit(None)).cast("int").alias("first_label"),
            *arrays,
        ),
    )


def _evidence_batches(df: DataFrame, rules: RuleSet, omegas: list[float], tables: dict) -> DataFrame:
    names = list(tables)
    field = T.StructField(
        "evidence",
        T._parse_datatype_string(
            "struct<n_fired:int,sum_omega:double,first_label:int," + ",".join(f"{n}:array<double>" for n in names) + ">"
        ),
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.concatenate([np.ones((len(rules), 1)), np.array([omegas]).T, *[np.array(tables[n]) for n in names]], axis=1)
        labels = np.array([-1 if r.label is None else r.label for r in rules], dtype=np.int32)
        for batch in batches:
            n = batch.num_rows
            sums, first, block = np.zeros((n, weights.shape[1])), np.full(n, -1, dtype=np.int32), []
            for i, hit in enumerate(batch_matrix(batch, rules)):
                block.append(hit)
                if labels[i] >= 0:
                    first[hit & (first < 0)] = labels[i]
                if len(block) == RULES_PER_BLOCK or i == len(rules) - 1:
                    sums += np.stack(block, axis=1).astype(np.float64) @ weights[i + 1 - len(block) : i + 1]
                    block = []
            columns = [pa.array(sums[:, 0].astype(np.int32)), pa.array(sums[:, 1]), pa.array(first, mask=first < 0)]
            at = 2
            for name in names:
                width = len(tables[name][0])
                offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1])
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(sums[:, at : at + width].ravel())))
                at += width
            evidence = pa.StructArray.from_arrays(columns, names=["n_fired", "sum_omega", "first_label", *names])
            yield pa.RecordBatch.from_arrays([*batch.columns, evidence], names=[*batch.schema.names, "evidence"])

    return df.mapInArrow(gather, T.StructType([*df.schema.fields, field]))


def dempster_vec(n_classes: int, evidence: str = "evidence") -> M.Vec:
    return M.from_log_ratios(M.unpack(F.col(f"{evidence}.log_ratio"), n_classes))


def vote_vec(n_classes: int, evidence: str = "evidence") -> M.Vec:
    """Share of fired labelled rules per class; all mass on omega when none fired."""
    votes = M.unpack(F.col(f"{evidence}.votes"), n_classes)
    seen = M.total(votes)
    shares = [F.when(seen > 0, v / F.greatest(seen, F.lit(1.0))).otherwise(F.lit(0.0)) for v in votes]
    return [*shares, F.when(seen > 0, F.lit(0.0)).otherwise(F.lit(1.0))]


def fold_masses(fired: Column, rules: RuleSet, pair) -> Column:
    """Ordered left fold of a pairwise rule over the fired rules; vacuous when none fired."""
    k1 = rules.n_classes + 1
    vectors = [F.array(*[F.lit(float(v)) for v in r.mass]) for r in rules]
    if [r.rule_id for r in rules] == list(range(len(rules))):
        mass_of = lambda rid: F.get(F.array(*vectors), rid)
    else:
        table = F.create_map(*[x for r, m in zip(rules, vectors) for x in (F.lit(r.rule_id).cast("int"), m)])
        mass_of = lambda rid: F.element_at(table, rid)
    vacuous = F.array(*[F.lit(0.0)] * (k1 - 1), F.lit(1.0))
    return F.aggregate(
        fired,
        vacuous,
        lambda acc, rid: F.array(*pair(M.unpack(acc, k1), M.unpack(mass_of(rid), k1))),
    )


def fuse_yager(df: DataFrame, rules: RuleSet, *, form: str | None = None) -> DataFrame:
    """df plus `yager array<double>`: conflict goes to omega; left fold in rule order.

    Yager's rule is not associative, so the order is part of the definition.
    """
    return fuse_yager_from(with_fired(df, rules, form=form), rules).drop("fired")


def fuse_yager_from(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """The same on rows that already carry `fired`."""
    return hits.withColumn("yager", fold_masses(F.col("fired"), rules, M.yager_pair))


def fuse_grouped(fired: DataFrame, rule_mass: DataFrame, key: Sequence[str], n_classes: int) -> DataFrame:
    """Dempster fusion as a plain aggregate over fired(key, rule_id) joined to rule masses.

    sum() combines map-side, so a row matched by very many rules never sits in one task.
    """
    ratio = lambda c: F.log1p(F.get("mass", F.lit(c)) / F.greatest(F.get("mass", F.lit(n_classes)), F.lit(OMEGA_FLOOR)))
    sums = (
        fired.join(small_side(rule_mass.select("rule_id", "mass")), "rule_id")
        .groupBy(*key)
        .agg(
            F.count("*").alias("n_fired"),
            F.avg(F.get("mass", F.lit(n_classes))).alias("unc_rule"),
            *[F.sum(ratio(c)).alias(f"L{c}") for c in range(n_classes)],
        )
    )
    fused = M.from_log_ratios([F.col(f"L{c}") for c in range(n_classes)])
    return sums.select(*key, "n_fired", "unc_rule", F.array(*fused).alias("mass"))


def combine_evidence(left: DataFrame, right: DataFrame, key: Sequence[str], n_classes: int, *, rule: str = "dempster") -> DataFrame:
    """Two mass tables joined on their key and combined pairwise."""
    pair = {"dempster": M.dempster_pair, "yager": M.yager_pair}[_known(rule, ("dempster", "yager"))]
    both = left.select(*key, F.col("mass").alias("a")).join(right.select(*key, F.col("mass").alias("b")), list(key))
    vec = pair(M.unpack(F.col("a"), n_classes + 1), M.unpack(F.col("b"), n_classes + 1))
    return both.select(*key, F.array(*vec).alias("mass"))


def normalise_mass_table(rules: DataFrame, n_classes: int, *, source: str = "params") -> DataFrame:
    """Bring a mass column onto the simplex and add its logits. `source` is `params` or `logits`."""
    raw = M.unpack(F.col("mass"), n_classes + 1)
    vec = M.softmax(raw) if _known(source, ("params", "logits")) == "logits" else M.normalise(raw)
    out = rules.withColumn("mass", F.array(*vec))
    return out.withColumn("logits", F.array(*M.to_logits(M.unpack(F.col("mass"), n_classes + 1))))


def _known(name: str, allowed: Sequence[str]) -> str:
    if name not in allowed:
        raise ValueError(f"unknown {name!r}, expected one of {', '.join(allowed)}")
    return name
