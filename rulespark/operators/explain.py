"""Why a row got its prediction: rule contributions, merged conditions and self-checks.

A rule's weight in an explanation depends only on the rule and the predicted class, so it is a lookup
in a K x R table of constants; contributions are computed inside the row without a join or shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.functions import mass as M
from rulespark.functions.arrays import unnest
from rulespark.operators import order_stats as O
from rulespark.operators.activate import with_fired
from rulespark.operators.predict import score
from rulespark.rules import RuleSet, default_caption


def vote_strength(rule, n_classes: int, alpha: float = 1.0) -> float:
    s, n = float(rule.stats.get("support") or 0), float(rule.stats.get("neg_covered") or 0)
    return (s + alpha) / (s + n + alpha * n_classes) * math.log1p(max(0.0, s))


def mass_weights(rules: RuleSet) -> list[list[float]]:
    """Mass on the predicted class, or minus the largest other class mass where that is larger."""
    def weight(mass, c):
        rest = max((m for i, m in enumerate(mass[:-1]) if i != c), default=0.0)
        return mass[c] if mass[c] >= rest else -rest

    return [[weight(r.mass, c) for r in rules] for c in range(rules.n_classes)]


def vote_weights(rules: RuleSet) -> list[list[float]]:
    """Plus or minus the rule's vote strength, by whether its label is the predicted class."""
    k = rules.n_classes
    return [[vote_strength(r, k) * (1 if r.label == c else -1) for r in rules] for c in range(k)]


def agreement_weights(rules: RuleSet, *, precision_weighted: bool = True) -> list[list[float]]:
    """certainty x mass x precision for agreeing rules, minus half of it for the others; unlabelled rules agree."""
    def weight(r, c):
        certainty = 1.0 - r.mass[-1]
        p = r.stats.get("precision") if precision_weighted else None
        scale = certainty * (1.0 if p is None else float(p))
        return scale * r.mass[c] if r.label in (None, c) else -0.5 * scale * r.mass[r.label]

    return [[weight(r, c) for r in rules] for c in range(rules.n_classes)]


def _indexed(rules: RuleSet) -> None:
    if [r.rule_id for r in rules] != list(range(len(rules))):
        raise ValueError("rule ids must be 0..R-1 in order")


def _doubles(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def with_contributions(df: DataFrame, rules: RuleSet, weights: list[list[float]], *, normalise: bool = True, pred: str = "pred") -> DataFrame:
    """df (with `fired` and the predicted class) plus `contributions array<struct<rule_id,label,omega,weight>>`,
    heaviest first. `normalise` scales the absolute weights of a row to sum to 1."""
    _indexed(rules)
    table = F.array(*[_doubles(row) for row in weights])
    omegas = _doubles([r.mass[-1] for r in rules])
    labels = F.array(*[F.lit(r.label).cast("int") for r in rules])
    raw = F.transform("fired", lambda i: F.struct(i.alias("rule_id"), F.get(F.get(table, F.col(pred)), i).alias("w")))
    out = df.withColumn("_raw", raw)
    size = F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + F.abs(x["w"]))
    out = out.withColumn("_size", F.when(size > 0, size).otherwise(1.0) if normalise else F.lit(1.0))
    items = F.transform(
        "_raw",
        lambda x: F.struct(
            (-F.abs(x["w"])).alias("o"), x["rule_id"].alias("rule_id"), F.get(labels, x["rule_id"]).alias("label"),
            F.get(omegas, x["rule_id"]).alias("omega"), (x["w"] / F.col("_size")).alias("weight"),
        ),
    )
    ordered = F.transform(
        F.array_sort(items),
        lambda x: F.struct(x["rule_id"].alias("rule_id"), x["label"].alias("label"), x["omega"].alias("omega"), x["weight"].alias("weight")),
    )
    return out.withColumn("contributions", ordered).drop("_raw", "_size")


def explained(df: DataFrame, rules: RuleSet, *, mode: str = "mass") -> DataFrame:
    """Score df, then attach fired rules and their contributions to the predicted class."""
    weights = {"mass": mass_weights, "vote": vote_weights, "agreement": agreement_weights}[mode](rules)
    method = "vote" if mode == "vote" else "dempster"
    scored = with_fired(score(df, rules, method=method), rules)
    return with_contributions(scored, rules, weights, normalise=mode != "agreement")


def contribution_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return unnest(df, [*key, "pred"], "contributions", "c").select(*key, "pred", "c.*")


def condition_texts(rules: RuleSet) -> Column:
    texts = [" AND ".join(f"{f} {op} {v:.6g}" for f, op, v in r.literals) for r in rules]
    return F.array(*[F.lit(t) for t in texts])


def combined_condition(rules: RuleSet) -> Column:
    """Literals of the rules that speak for the prediction, heaviest first; the top rule's if none does."""
    texts = condition_texts(rules)
    text_of = lambda x: F.get(texts, x["rule_id"])
    positive = F.transform(F.filter("contributions", lambda x: x["weight"] > 0), text_of)
    top = F.transform(F.slice("contributions", 1, 1), text_of)
    return F.array_join(F.when(F.size(positive) > 0, positive).otherwise(top), " AND ")


def firing_examples(df: DataFrame, rules: RuleSet, key: Sequence[str], limit: int, *, mode: str = "mass") -> DataFrame:
    """The rows with the most fired rules and the combined condition of each; `example` marks the first that has one.

    Rows are ranked by how many rules fire, in every task first; only those that stay are scored and explained.
    """
    fired = with_fired(df, rules).withColumn("n_fired", F.size("fired")).where("n_fired > 0")
    top = fired.orderBy(F.desc("n_fired"), *key).limit(limit).drop("fired", "n_fired")
    rows = explained(top, rules, mode=mode).select(*key, "n_fired", combined_condition(rules).alias("condition"))
    place = F.struct(F.length(F.trim("condition")) == 0, -F.col("n_fired"), *key)
    first = F.min(place).over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # `limit` rows
    return rows.withColumn("example", place == first)


def rules_pool(rules: RuleSet) -> Column:
    captions = F.array(*[F.lit(r.caption or default_caption(r.literals)) for r in rules])
    masses = F.array(*[_doubles([round(m, 6) for m in r.mass]) for r in rules])
    return F.transform(
        "contributions",
        lambda x: F.struct(
            x["rule_id"].alias("rule_id"), x["label"].alias("rule_class"),
            F.get(captions, x["rule_id"]).alias("rule_text"), F.get(masses, x["rule_id"]).alias("mass_vector"),
        ),
    )


def contribution_literals(df: DataFrame, rules: RuleSet, key: Sequence[str], *, positive_only: bool = False) -> DataFrame:
    """(key..., feature, op, value, rule_id, omega, weight, n_literals): literals of the contributing rules."""
    lits = F.array(
        *[
            F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), F.lit(float(v)).alias("value")) for f, op, v in r.literals])
            for r in rules
        ]
    )
    rows = unnest(df, list(key), "contributions", "c")
    if positive_only:
        rows = rows.where("c.weight > 0")
    rows = rows.withColumn("l", F.get(lits, F.col("c.rule_id")))
    kept = [*key, "c.rule_id", "c.omega", "c.weight", F.size("l").alias("n_literals")]
    return unnest(rows, kept, "l", "lit").select(*key, "lit.*", "rule_id", "omega", "weight", "n_literals")


def _entries(rules: RuleSet) -> dict[str, list[tuple[int, str, float, int]]]:
    """feature -> (rule_id, op, value, literals of the rule), features in order."""
    out: dict[str, list] = {f: [] for f in rules.features}
    for r in rules:
        for f, op, v in r.literals:
            out[f].append((r.rule_id, op, float(v), len(r.literals)))
    return out


def _spoken(entries: list[tuple[int, str, float, int]], part) -> Column:
    """array of part(contribution, entry) for the literals of one feature whose rule contributes to the row.

    Rules and literals are known when the plan is built: a rule's literals are a lookup by its id.
    """
    by_rule: dict[int, list] = {}
    for rule_id, *entry in entries:
        by_rule.setdefault(rule_id, []).append(entry)
    place = {rule_id: i for i, rule_id in enumerate(by_rule)}
    ids = F.array(*[F.lit(i) for i in by_rule])
    kind = lambda e: F.struct(F.lit(e[0]).alias("op"), F.lit(e[1]).alias("value"), F.lit(e[2]).alias("n_literals"))
    table = F.array(*[F.array(*[kind(e) for e in by_rule[i]]) for i in place])
    own = F.filter("contributions", lambda c: F.array_contains(ids, c["rule_id"].cast("int")))
    at = lambda c: F.get(table, (F.array_position(ids, c["rule_id"].cast("int")) - 1).cast("int"))
    return F.flatten(F.transform(own, lambda c: F.transform(at(c), lambda e: part(c, e))))


def merge_literals(df: DataFrame, rules: RuleSet, key: Sequence[str], *, beta: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Per row (with `contributions`) and feature the merged literal of all contributing rules, with its share of certainty.

    Bounds tighten to the largest `>` and the smallest `<`; more than one `==` value, an `==` outside a
    bound, or crossed bounds are contradictions. certainty = 1 - prod(1 - |weight| (1 - omega)) over the
    contributors, and `confidence` is certainty^beta normalised over the row's features. All within the row: no shuffle.
    """
    def cell(c: Column, e: Column) -> Column:
        strength = F.least(F.greatest(F.abs(c["weight"]) * (1.0 - c["omega"]), F.lit(0.0)), F.lit(1.0))
        # log(0) for a certain rule is kept out of the sum and restored by `sure`
        rest = F.when(strength < 1.0, F.log1p(-strength)).otherwise(0.0)
        return F.struct(e["op"].alias("op"), e["value"].alias("value"), rest.alias("lr"), (strength >= 1.0).alias("sure"))

    entries = _entries(rules)
    names = {f: f"_items{i}" for i, f in enumerate(entries)}
    rows = df.select(*key, *[_spoken(e, cell).alias(names[f]) for f, e in entries.items()])
    of = lambda items, op: F.transform(F.filter(items, lambda i: i["op"] == op), lambda i: i["value"])
    bounds = lambda items: F.struct(
        F.array_min(of(items, "==")).alias("eq"), F.array_max(of(items, "==")).alias("top"), F.array_max(of(items, ">")).alias("gt"), F.array_min(of(items, "<")).alias("lt")
    )
    rows = rows.select("*", *[bounds(names[f]).alias(f"_b{i}") for i, f in enumerate(entries)])

    def merged(f: str, items: str, b: Column) -> Column:
        eq, gt, lt = b["eq"], b["gt"], b["lt"]
        many = F.coalesce(b["top"] > eq, F.lit(False))
        outside = F.coalesce(~(eq > gt), F.lit(False)) | F.coalesce(~(eq < lt), F.lit(False))
        contradiction = F.when(eq.isNotNull(), many | outside).otherwise(F.coalesce(gt >= lt, F.lit(False)))
        used = F.filter(
            items,
            lambda i: F.when(eq.isNull() | (i["op"] == "=="), True).when(many, False).when(i["op"] == ">", eq > i["value"]).otherwise(eq < i["value"]),
        )
        rest = F.aggregate(used, F.lit(0.0), lambda acc, i: acc + i["lr"])
        certainty = F.when(F.size(used) == 0, 0.0).when(F.exists(used, lambda i: i["sure"]), 1.0).otherwise(1.0 - F.exp(rest))
        return F.when(
            F.size(items) > 0,
            F.struct(F.lit(f).alias("feature"), eq.alias("eq"), gt.alias("gt"), lt.alias("lt"), contradiction.alias("contradiction"),
                     F.size(used).alias("n_contributors"), certainty.alias("certainty")),
        )

    cells = F.array_compact(F.array(*[merged(f, names[f], F.col(f"_b{i}")) for i, f in enumerate(entries)]))
    rows = rows.select(*key, cells.alias("_cells"))
    raw = lambda c: F.pow(F.greatest(c["certainty"], F.lit(eps)), F.lit(float(beta)))
    total = F.aggregate("_cells", F.lit(0.0), lambda acc, c: acc + raw(c))
    rows = rows.withColumn("_total", F.greatest(total, F.lit(eps)))
    out = unnest(rows, [*key, "_total"], "_cells", "c").select(*key, "c.*", "_total")
    return out.withColumn("confidence", F.pow(F.greatest("certainty", F.lit(eps)), F.lit(float(beta))) / F.col("_total")).drop("_total")


def literal_expression() -> Column:
    """The merged literal as text: `f == v`, `a < f < b`, `f > a`, `f < b` or CONTRADICTION(f)."""
    from rulespark.operators.rule_table import number_text

    f = F.col("feature")
    eq, gt, lt = (number_text(F.col(c)) for c in ("eq", "gt", "lt"))
    return (
        F.when(F.col("contradiction"), F.concat(F.lit("CONTRADICTION("), f, F.lit(")")))
        .when(F.col("eq").isNotNull(), F.concat(f, F.lit(" == "), eq))
        .when(F.col("gt").isNotNull() & F.col("lt").isNotNull(), F.concat(gt, F.lit(" < "), f, F.lit(" < "), lt))
        .when(F.col("gt").isNotNull(), F.concat(f, F.lit(" > "), gt))
        .otherwise(F.concat(f, F.lit(" < "), lt))
    )


def merged_summary(merged: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., combined_summary): `0.512*[expr] + ...`, most confident first."""
    conf = F.round("confidence", 6)
    item = F.struct((-conf).alias("o"), F.col("feature"), F.concat(F.format_string("%.3f", conf), F.lit("*["), literal_expression(), F.lit("]")).alias("t"))
    return merged.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("i")).select(
        *key, F.array_join(F.col("i.t"), " + ").alias("combined_summary")
    )


def explain_summary(df: DataFrame, rules: RuleSet, key: Sequence[str], prior: Sequence[float] | None = None) -> DataFrame:
    """Per row: predicted class, fused omega, final confidence, agreeing and conflicting rules and their weights."""
    k = rules.n_classes
    prior = list(prior) if prior is not None else [1.0 / k] * k
    rows = explained(df, rules, mode="agreement")
    conf = M.final_confidence(M.unpack(F.col("mass"), k + 1), prior)
    agrees = F.filter("contributions", lambda x: x["label"].isNull() | (x["label"] == F.col("pred")))
    total = lambda keep: F.aggregate(F.filter("contributions", keep), F.lit(0.0), lambda acc, x: acc + x["weight"])
    return rows.select(
        *key, F.col("pred").alias("predicted_class"), F.col("unc_comb").alias("combined_omega"), conf["final_conf"].alias("final_conf"),
        F.col("n_fired").alias("n_rules_fired"), F.size(agrees).alias("n_agreeing"),
        (F.size("contributions") - F.size(agrees)).alias("n_conflicting"),
        total(lambda x: x["weight"] > 0).alias("weight_for"), total(lambda x: x["weight"] < 0).alias("weight_against"),
    )


def combine_literals(df: DataFrame, rules: RuleSet, key: Sequence[str]) -> DataFrame:
    """Per row (with `contributions`), feature and operator: heaviest `==` value, largest `>`, smallest `<`, and the summed weight.

    Each positive rule spreads its weight evenly over its literals. All within the row: no shuffle.
    """
    entries = _entries(rules)
    cells = []
    for i, (f, found) in enumerate(entries.items()):
        item = lambda c, e: F.when(c["weight"] > 0, F.struct(e["op"].alias("op"), e["value"].alias("value"), (F.abs(c["weight"]) / e["n_literals"]).alias("w")))
        cells.append(F.array_compact(_spoken(found, item)).alias(f"_items{i}"))
    rows = df.select(*key, *cells)
    out = []
    for i, (f, found) in enumerate(entries.items()):
        for op in sorted({e[1] for e in found}):
            own = F.filter(f"_items{i}", lambda x: x["op"] == op)
            weight = lambda items: F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["w"])
            values = F.transform(own, lambda x: x["value"])
            if op == "==":
                heaviest = F.transform(
                    F.array_distinct(values), lambda v: F.struct((-F.round(weight(F.filter(own, lambda x: x["value"] == v)), 12)).alias("o"), v.alias("v"))
                )
                best = F.array_min(heaviest)["v"]
            else:
                best = F.array_max(values) if op == ">" else F.array_min(values)
            cell = F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), best.alias("value"), weight(own).alias("weight"))
            out.append(F.when(F.size(own) > 0, cell))
    merged = rows.select(*key, F.array_compact(F.array(*out)).alias("_cells"))
    return unnest(merged, list(key), "_cells", "c").select(*key, "c.*")


def combined_rule_length_stats(df: DataFrame, rules: RuleSet, key: Sequence[str], *, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Mean, median and empty share of the number of combined literals, on all rows or on a hash sample of the size asked for.

    The count of distinct (feature, op) pairs among positive rules is found inside the row.
    """
    if sample is not None:
        pooled = df.withColumn("_all", F.lit(0))
        cuts = O.hash_cuts(pooled, "_all", key, {0: sample}, seed)
        df = O.with_drawn(pooled, "_all", key, seed, cuts, "_in").where("_in").drop("_all", "_in")
    pairs = F.array(*[F.array(*[F.lit(f"{f} {op}") for f, op, _ in r.literals]) for r in rules])
    used = F.flatten(F.transform(F.filter("contributions", lambda x: x["weight"] > 0), lambda x: F.get(pairs, x["rule_id"])))
    rows = explained(df, rules, mode="agreement").select(F.size(F.array_distinct(used)).alias("n"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"),
        F.avg((F.col("n") == 0).cast("double")).alias("empty_rate"),
    )


def inspect_rows(df: DataFrame, rules: RuleSet, key: Sequence[str], *, method: str = "dempster") -> DataFrame:
    """One JSON payload per row (prediction, activation, combined rule) and the checks on it."""
    mode = "vote" if method == "vote" else "mass"
    weights = vote_weights(rules) if mode == "vote" else mass_weights(rules)
    rows = with_contributions(with_fired(score(df, rules, method=method), rules), rules, weights)
    rows = rows.withColumn("combined_condition", combined_condition(rules)).withColumn("rules_pool", rules_pool(rules))
    sums = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    rows = rows.select(
        "*",
        (F.abs(sums - 1.0) <= 1e-4).alias("probabilities_sum_to_one"),
        (F.size("fired") == F.col("n_fired")).alias("fired_rule_count_matches"),
        ((F.col("n_fired") == 0) | (F.length("combined_condition") > 0)).alias("combined_rule_present"),
    )
    warning = F.when(F.col("n_fired") == 0, "no rule fired: the row lies outside the rules' support").when(
        ~F.col("combined_rule_present"), "a rule fired but the combined explanation is empty"
    )
    payload = F.to_json(
        F.struct(
            F.struct("pred", "proba", "mass", "unc_rule", "unc_comb").alias("prediction"),
            F.struct(F.col("n_fired").alias("n_rules_fired"), "fired").alias("activation"),
            F.struct("combined_condition", "rules_pool").alias("combined_rule"),
        )
    )
    checks = ["probabilities_sum_to_one", "fired_rule_count_matches", "combined_rule_present"]
    passed = F.col(checks[0]) & F.col(checks[1]) & F.col(checks[2])
    return rows.select(*key, "pred", "n_fired", payload.alias("payload"), *checks, passed.alias("all_passed"), warning.alias("warning"))


def conformance_checks(scored: DataFrame, n_classes: int, *, eps: float = 1e-6) -> DataFrame:
    """Algebra of the fused masses over every row: sums, signs, commutativity, vacuous identity, as counts of failures."""
    k1 = n_classes + 1
    m = M.unpack(F.col("mass"), k1)
    shifted = [*m[1:n_classes], m[0], m[n_classes]]
    vacuous = [F.lit(0.0)] * n_classes + [F.lit(1.0)]
    ab, ba, same = M.dempster_pair(m, shifted), M.dempster_pair(shifted, m), M.dempster_pair(m, vacuous)
    gap = lambda xs, ys: M.biggest([F.abs(x - y) for x, y in zip(xs, ys)])
    rows = scored.select(
        (F.abs(M.total(m) - 1.0) <= eps).alias("sum_to_one"), (F.least(*m) >= -eps).alias("non_negative"),
        (gap(ab, ba) <= eps).alias("commutative"), (gap(same, m) <= eps).alias("vacuous_identity"),
    )
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.col(c)).alias(f"bad_{c}") for c in rows.columns])


def prediction_invariance(df: DataFrame, before: RuleSet, after: RuleSet) -> DataFrame:
    """Largest change of the vote probabilities between two rule sets: 0 when only masses were trained."""
    k = before.n_classes
    a = score(df, before, method="vote").withColumnRenamed("proba", "before").drop("n_fired", "mass", "pred", "unc_rule", "unc_comb")
    b = score(a, after, method="vote")
    gaps = [F.abs(x - y) for x, y in zip(M.unpack(F.col("before"), k), M.unpack(F.col("proba"), k))]
    return b.agg(F.count("*").alias("n_rows"), F.max(M.biggest(gaps)).alias("max_delta"))
