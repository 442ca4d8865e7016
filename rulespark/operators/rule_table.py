"""Operations on the rules table itself, as DataFrame work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulespark.functions import gain
from rulespark.rules import literals_of
from rulespark.session import small_side

_LITERALS = "array<struct<feature:string,op:string,value:double>>"


def snap(value: Column, eps: float = 1e-9) -> Column:
    """Values within `eps` of an integer become that integer."""
    near = F.round(value)
    return F.when(F.abs(value - near) < eps, near).otherwise(value)


def canonicalize_rules(rules: DataFrame, *, eps: float = 1e-9) -> DataFrame:
    """Keep the tightest bounds per feature; rules that cannot hold, or that have no literal, vanish.

    Two different `==` on a feature, an `==` outside the bounds or a lower bound at or above the upper
    one are contradictions. A surviving `==` replaces the bounds.
    """
    op, v = F.col("op"), F.col("v")
    lits = literals_of(rules).select("rule_id", "feature", "op", snap(F.col("value")).alias("v"))
    per_feature = lits.groupBy("rule_id", "feature").agg(
        F.min(F.when(op == "==", v)).alias("eq"), F.max(F.when(op == "==", v)).alias("eq_top"),
        F.max(F.when(op == ">", v)).alias("gt"), F.min(F.when(op == "<", v)).alias("lt"),
    )
    eq, gt, lt = F.col("eq"), F.col("gt"), F.col("lt")
    broken = F.coalesce(
        (F.col("eq_top") - eq > eps) | (eq.isNotNull() & ((eq >= lt - eps) | F.lit(False))), F.lit(False)
    ) | F.coalesce(eq.isNotNull() & (eq <= gt + eps), F.lit(False)) | F.coalesce(eq.isNull() & (gt >= lt - eps), F.lit(False))
    kept = F.when(eq.isNotNull(), F.array(_literal("==", eq))).otherwise(
        F.concat(
            F.when(gt.isNotNull(), F.array(_literal(">", gt))).otherwise(F.array().cast(_LITERALS)),
            F.when(lt.isNotNull(), F.array(_literal("<", lt))).otherwise(F.array().cast(_LITERALS)),
        )
    )
    parts = per_feature.select("rule_id", "feature", broken.alias("broken"), kept.alias("lits"))
    merged = parts.groupBy("rule_id").agg(
        F.bool_or("broken").alias("broken"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("feature", "lits"))), lambda p: p["lits"])).alias("literals"),
    )
    fresh = merged.where("NOT broken").select("rule_id", "literals", F.size("literals").alias("n_literals"))
    return rules.drop("literals", "n_literals").join(fresh, "rule_id").select(*rules.columns)


def _literal(op: str, value: Column) -> Column:
    return F.struct(F.col("feature").alias("feature"), F.lit(op).alias("op"), value.alias("value"))


def rule_signature(literals: Column) -> Column:
    return F.array_join(F.transform(literals, lambda l: F.concat(l["feature"], l["op"], l["value"].cast("string"))), "&&")


def dedupe_rules(rules: DataFrame) -> DataFrame:
    """The first rule (lowest id) of every signature; combines map-side, so copies never pile up."""
    row = F.struct(*rules.columns)
    return (
        rules.groupBy(rule_signature(F.col("literals")).alias("signature"))
        .agg(F.min_by(row, "rule_id").alias("r"))
        .select("r.*")
    )


def number_text(value: Column, digits: int = 6) -> Column:
    """A double at `digits` significant digits, without a trailing .0."""
    size = F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300))))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    text = F.when(value == 0, F.lit("0")).otherwise((F.rint(value * scale) / scale).cast("string"))
    return F.regexp_replace(text, r"\.0$", "")


def rule_captions(rules: DataFrame, value_dim: DataFrame | None = None, *, digits: int = 6) -> DataFrame:
    """(rule_id, caption): `feature op value & ...`, codes of dictionary features shown as their strings."""
    lits = literals_of(rules)
    if value_dim is not None:
        names = value_dim.select("feature", F.col("code").cast("double").alias("value"), F.col("value").alias("name"))
        lits = lits.join(small_side(names), ["feature", "value"], "left")
    else:
        lits = lits.withColumn("name", F.lit(None).cast("string"))
    shown = F.coalesce(F.col("name"), number_text(F.col("value"), digits))
    text = F.concat_ws(" ", "feature", "op", shown)
    words = lits.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("w"))
    return words.select("rule_id", F.array_join(F.col("w.t"), " & ").alias("caption"))


def rulebase_stats(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rules.groupBy(*by).agg(
        F.count("*").alias("n_rules"), F.avg("n_literals").alias("avg_literals"),
        F.avg(F.col("label").isNotNull().cast("double")).alias("labeled_ratio"),
    )


def generation_counts(rules: DataFrame) -> DataFrame:
    """(section, item, n): rules per stage and per class, and how many went through pool shaping."""
    cells = F.array(
        F.struct(F.lit("stage").alias("section"), F.coalesce(F.col("stats.stage"), F.lit("unknown")).alias("item")),
        F.struct(F.lit("class").alias("section"), F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("item")),
        F.struct(F.lit("shaped").alias("section"), F.col("stats.pool_score").isNotNull().cast("string").alias("item")),
    )
    return rules.select(F.explode(cells).alias("c")).groupBy("c.section", "c.item").agg(F.count("*").alias("n"))


def top_rules(rules: DataFrame, by: str, k: int = 12) -> DataFrame:
    """The k rules with the largest stats.<by>; ties by rule id."""
    score = F.coalesce(F.col(f"stats.{by}").cast("double"), F.lit(0.0))
    return rules.select(
        "rule_id", "label", F.col("stats.stage").alias("stage"), F.col("stats.support").alias("support"),
        F.col("stats.precision").alias("precision"), "n_literals", score.alias("score"),
    ).orderBy(F.desc("score"), "rule_id").limit(k)


def certainty_score(n_classes: int, *, mode: str = "certainty_label_mass") -> Column:
    """1 - omega, times the mass on the rule's own label (0 when it has none) in the default mode."""
    if mode not in ("certainty", "certainty_label_mass"):
        raise ValueError("mode must be 'certainty' or 'certainty_label_mass'")
    omega = F.least(F.greatest(F.get("mass", F.lit(n_classes)), F.lit(0.0)), F.lit(1.0))
    if mode == "certainty":
        return 1.0 - omega
    valid = F.col("label").between(0, n_classes - 1)
    return (1.0 - omega) * F.when(valid, F.get("mass", F.col("label"))).otherwise(F.lit(0.0))


def sort_rules_by_certainty(rules: DataFrame, n_classes: int, *, mode: str = "certainty_label_mass") -> DataFrame:
    """Rules with their `score`, most certain first (a range-partitioned sort)."""
    return rules.withColumn("score", F.coalesce(certainty_score(n_classes, mode=mode), F.lit(0.0))).orderBy(
        F.desc("score"), "rule_id"
    )


def rule_vote_strength(rules: DataFrame, n_classes: int, *, alpha: float = 1.0) -> DataFrame:
    support, neg = (F.coalesce(F.col(f"stats.{c}"), F.lit(0)) for c in ("support", "neg_covered"))
    return rules.withColumn("strength", gain.vote_strength(support, neg, n_classes, alpha))
