"""Which rules fire on which rows.

Three physical forms of the same row x rule match:

* `activate_columns`: the rules become predicates in the plan. No shuffle, all in generated code.
* `activate_batches`: for long rule lists, vectorised literal tests over Arrow batches. No shuffle.
* `activate_relational`: for rule tables too large for the driver, literals are joined on the feature
  and a rule fires when as many of its literals match as it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulespark.functions.arrays import balanced, unnest
from rulespark.functions.literals import holds_dynamic, rule_holds
from rulespark.rules import EQ_TOLERANCE, RuleSet, literals_of
from rulespark.session import fits_broadcast, small_side

# Up to here generated predicates beat Arrow transfer (measured at 600k rows on 8 cores).
COLUMN_FORM_MAX_LITERALS = 96
COLUMN_FORM_MAX_RULES = 48


def choose_form(rules: RuleSet) -> str:
    few = rules.n_distinct_literals <= COLUMN_FORM_MAX_LITERALS and len(rules) <= COLUMN_FORM_MAX_RULES
    return "columns" if few else "batches"


def rule_flags(rules: RuleSet) -> list[Column]:
    return [F.coalesce(rule_holds(r.literals, exact_eq=rules.exact_eq), F.lit(False)) for r in rules]


def fired_column(rules: RuleSet) -> Column:
    """Ascending array of the ids of the rules that hold on the row."""
    if not len(rules):
        return F.array().cast("array<int>")
    ids = [F.when(flag, F.lit(r.rule_id)).otherwise(F.lit(-1)).cast("int") for r, flag in zip(rules, rule_flags(rules))]
    return F.array_remove(F.array(*ids), F.lit(-1))


def batch_matrix(batch: pa.RecordBatch, rules: RuleSet) -> Iterator[np.ndarray]:
    """Yield, rule by rule, the boolean vector of rows it fires on; each distinct literal is tested once."""
    # numbers beyond 2^53 round to the nearest double, as the column form's cast does
    columns = {
        f: batch.column(batch.schema.get_field_index(f)).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        for f in rules.features
    }
    tested: dict[tuple, np.ndarray] = {}
    for rule in rules:
        hit = np.ones(batch.num_rows, dtype=bool)
        for lit in rule.literals:
            if lit not in tested:
                f, op, v = lit
                x = columns[f]
                with np.errstate(invalid="ignore"):
                    if op == "<":
                        tested[lit] = x < v
                    elif op == ">":
                        tested[lit] = x > v
                    else:
                        tested[lit] = (x == v) if rules.exact_eq else np.abs(x - v) <= EQ_TOLERANCE + EQ_TOLERANCE * abs(v)
            hit &= tested[lit]
        yield hit


def fired_lists(batch: pa.RecordBatch, rules: RuleSet, ids: np.ndarray) -> pa.ListArray:
    """The ids of the rules that fire on each row, ascending by rule; holds the hits, not a row x rule matrix."""
    found = [np.flatnonzero(hit) for hit in batch_matrix(batch, rules)]
    rows = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    cols = np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(batch.num_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[cols[order]], pa.int32()))


def with_fired(df: DataFrame, rules: RuleSet, *, form: str | None = None) -> DataFrame:
    """df plus `fired array<int>`, row-local."""
    if (form or choose_form(rules)) == "columns":
        return df.withColumn("fired", fired_column(rules))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r.rule_id for r in rules], dtype=np.int32)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, fired_lists(batch, rules, ids)], names=[*batch.schema.names, "fired"])

    schema = T.StructType([*df.schema.fields, T.StructField("fired", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(match, schema)


def activate(df: DataFrame, rules: RuleSet, key: Sequence[str], *, form: str | None = None) -> DataFrame:
    """fired(key..., rule_id): one row per (row, fired rule)."""
    needed = list(dict.fromkeys([*key, *rules.features]))
    hits = with_fired(df.select(*needed), rules, form=form)
    return unnest(hits, list(key), F.col("fired").cast("array<bigint>"), "rule_id")


def melt(df: DataFrame, key: Sequence[str], features: Sequence[str], *, value: str = "value") -> DataFrame:
    """(key..., feature, value): one row per feature, values as double."""
    names = F.array(*[F.lit(f) for f in features])
    cells = F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("_at", value)
    return df.select(*key, cells).select(*key, F.get(names, F.col("_at")).alias("feature"), value)


def activate_relational(
    df: DataFrame, rules: DataFrame, key: Sequence[str], features: Sequence[str], *, salts: int = 32, exact_eq: bool = False
) -> DataFrame:
    """Relational division: (cells joined to distinct literals) joined to rules, counted per (row, rule).

    A feature name is a join key every row shares, so when the literals are too many to broadcast the
    join is salted: cells get one of `salts` values, literals are repeated for each.
    """
    literals = literals_of(rules).select("rule_id", "feature", "op", F.col("value").alias("bound"))
    distinct = literals.select("feature", "op", "bound").distinct()
    cells = melt(df, key, features)
    if fits_broadcast(distinct, 100_000):
        matched = cells.join(F.broadcast(distinct), "feature")
    else:
        salted = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = cells.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
        matched = spread.join(salted, ["feature", "salt"])
    matched = matched.where(holds_dynamic(F.col("value"), F.col("op"), F.col("bound"), exact_eq=exact_eq)).select(
        *key, "feature", "op", "bound"
    )
    owners = literals.join(rules.select("rule_id", "n_literals"), "rule_id")
    if fits_broadcast(owners, 100_000):
        owners = F.broadcast(owners)
    return (
        matched.join(owners, ["feature", "op", "bound"])
        .groupBy(*key, "rule_id", "n_literals")
        .count()
        .where(F.col("count") == F.col("n_literals"))
        .select(*key, "rule_id")
    )


def literal_truth(df: DataFrame, rules: RuleSet, key: Sequence[str]) -> DataFrame:
    """E1: rows per distinct literal, with how often it holds; each literal is tested once per row."""
    lits = sorted({lit for r in rules for lit in r.literals})
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(op).alias("op"),
            F.lit(float(v)).alias("value"),
            F.coalesce(rule_holds([(f, op, v)], exact_eq=rules.exact_eq), F.lit(False)).alias("holds"),
        )
        for f, op, v in lits
    ]
    return df.select(*key, F.explode(F.array(*cells)).alias("lit")).select(*key, "lit.*")


def rule_counts(df: DataFrame, rules: RuleSet, *, positive: Column | None = None, form: str | None = None) -> DataFrame:
    """(rule_id, support, neg_covered): rows each rule covers, split by the predicate `positive`.

    The fired rules are summed map-side, so only rules x partitions rows are shuffled however often a
    rule fires.
    """
    flag = F.lit(True) if positive is None else F.coalesce(positive, F.lit(False))
    hits = with_fired(df.select(*rules.features, flag.alias("is_pos")), rules, form=form)
    return (
        unnest(hits, ["is_pos"], F.col("fired").cast("array<bigint>"), "rule_id")
        .groupBy("rule_id")
        .agg(F.count_if("is_pos").alias("support"), F.count_if(~F.col("is_pos")).alias("neg_covered"))
    )


def fired_overview(df: DataFrame, rules: RuleSet, key: Sequence[str]) -> DataFrame:
    """Per row: number of fired rules and their captions in rule order."""
    captions = F.array(*[F.lit(r.caption or "") for r in rules])
    index = {r.rule_id: i for i, r in enumerate(rules)}
    if list(index) != list(range(len(rules))):
        raise ValueError("rule ids must be 0..R-1 in order")
    return with_fired(df, rules).select(
        *key,
        F.size("fired").alias("n_fired"),
        F.array_join(F.transform("fired", lambda i: F.get(captions, i)), " ; ").alias("captions"),
    )


def any_rule_holds(rules: Sequence) -> Column:
    flags = [F.coalesce(rule_holds(r.literals), F.lit(False)) for r in rules]
    return balanced(or_, flags) if flags else F.lit(False)
