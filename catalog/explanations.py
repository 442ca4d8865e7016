"""Explanation queries (I) over every order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.common import ORDER_RULES, ORDERS_SQL, Registry, fired_sql, fused_sql, orders, rounded, rounded_sql
from rulespark.operators import explain as X, predict
from rulespark.rules import RuleSet

registry = Registry()
query = registry.query

KEY = ["o_orderkey"]
RULES = RuleSet(
    tuple(replace(r, stats={**r.stats, "precision": r.stats["support"] / (r.stats["support"] + r.stats["neg_covered"])}) for r in ORDER_RULES),
    ORDER_RULES.n_classes,
    ORDER_RULES.default_label,
)
FUSED = fused_sql("ord", ["o_orderkey", "y"], RULES)
FIRED = fired_sql("ord", ["o_orderkey"], RULES)


def _weights_sql(name: str, table: list[list[float]]) -> str:
    """CTE (rule_id, pred, w, label, omega): explanation weights per rule and predicted class."""
    rows = ", ".join(
        f"({r.rule_id}::BIGINT, {c}, {table[c][i]!r}::DOUBLE, {'NULL' if r.label is None else r.label}::INTEGER, {r.mass[-1]!r}::DOUBLE)"
        for c in range(len(table)) for i, r in enumerate(RULES)
    )
    return f"{name}(rule_id, pred, w, label, omega) AS (VALUES {rows})"


def _literals_sql() -> str:
    rows = ", ".join(
        f"({r.rule_id}::BIGINT, '{f}', '{op}', {float(v)!r}::DOUBLE, {len(r.literals)})" for r in RULES for f, op, v in r.literals
    )
    return f"rule_lits(rule_id, feature, op, value, n_literals) AS (VALUES {rows})"


def _contrib_sql(table, normalise: bool = True) -> str:
    size = "nullif(sum(abs(w)) OVER (PARTITION BY o_orderkey), 0)" if normalise else "1"
    return (
        f"WITH {ORDERS_SQL}, {FUSED}, {FIRED}, {_weights_sql('tab', table)}, "
        f"con AS (SELECT o_orderkey, pred, rule_id, label, omega, coalesce(w / {size}, 0) AS weight "
        "FROM fired JOIN fused USING (o_orderkey) JOIN tab USING (rule_id, pred))"
    )


@query(
    "i2_rule_contributions",
    rounded_sql(f"{_contrib_sql(X.mass_weights(RULES))} SELECT * FROM con", "weight omega"),
)
def i2_rule_contributions(spark, sf_dir):
    return rounded(X.contribution_rows(X.explained(orders(spark, sf_dir), RULES), KEY))


VOTED = """, vp AS (SELECT o_orderkey, v0, v1, v2, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS pred FROM
    (SELECT o_orderkey, count(*) FILTER (WHERE label = 0) AS v0, count(*) FILTER (WHERE label = 1) AS v1, count(*) FILTER (WHERE label = 2) AS v2
     FROM fired JOIN (SELECT DISTINCT rule_id, label FROM tab) USING (rule_id) GROUP BY 1))"""


@query(
    "i3_vote_contributions",
    rounded_sql(
        f"WITH {ORDERS_SQL}, {FIRED}, {_weights_sql('tab', X.vote_weights(RULES))}{VOTED} "
        "SELECT o_orderkey, pred, rule_id, label, omega, w / sum(abs(w)) OVER (PARTITION BY o_orderkey) AS weight "
        "FROM fired JOIN vp USING (o_orderkey) JOIN tab USING (rule_id, pred)",
        "weight omega",
    ),
)
def i3_vote_contributions(spark, sf_dir):
    return rounded(X.contribution_rows(X.explained(orders(spark, sf_dir), RULES, mode="vote"), KEY))


MERGED = f"""{_contrib_sql(X.mass_weights(RULES))}, {_literals_sql()},
it AS (SELECT o_orderkey, feature, op, value, least(greatest(abs(weight) * (1 - omega), 0), 1) AS s FROM con JOIN rule_lits USING (rule_id)),
pf AS (SELECT o_orderkey, feature, min(value) FILTER (WHERE op = '==') AS eq, max(value) FILTER (WHERE op = '==') AS eq2,
              max(value) FILTER (WHERE op = '>') AS gt, min(value) FILTER (WHERE op = '<') AS lt FROM it GROUP BY ALL),
mm AS (SELECT o_orderkey, feature, eq, gt, lt, CASE WHEN eq IS NOT NULL THEN coalesce(eq2 > eq, false) OR coalesce(NOT eq > gt, false)
              OR coalesce(NOT eq < lt, false) ELSE coalesce(gt >= lt, false) END AS contradiction,
              count(*) FILTER (WHERE used)::INTEGER AS n_contributors, 1 - coalesce(product(1 - s) FILTER (WHERE used), 1) AS certainty
       FROM (SELECT it.*, eq, eq2, gt, lt, CASE WHEN eq IS NULL OR op = '==' THEN true WHEN eq2 > eq THEN false
                    WHEN op = '>' THEN eq > value ELSE eq < value END AS used FROM it JOIN pf USING (o_orderkey, feature)) GROUP BY o_orderkey, feature, eq, eq2, gt, lt)"""


@query(
    "i4_merge_literals",
    rounded_sql(
        f"{MERGED} SELECT *, greatest(certainty, 1e-8) / greatest(sum(greatest(certainty, 1e-8)) OVER (PARTITION BY o_orderkey), 1e-8) AS confidence FROM mm",
        "certainty confidence",
    ),
)
def i4_merge_literals(spark, sf_dir):
    return rounded(X.merge_literals(X.explained(orders(spark, sf_dir), RULES), RULES, KEY))


_NUM = lambda c: f"printf('%.6g', {c})"


@query(
    "i4_merged_summary",
    f"""{MERGED}, cf AS (SELECT *, round(greatest(certainty, 1e-8) / greatest(sum(greatest(certainty, 1e-8)) OVER (PARTITION BY o_orderkey), 1e-8), 6) AS conf FROM mm)
    SELECT o_orderkey, string_agg(printf('%.3f', floor(conf * 1000 + 0.5 + 1e-9) / 1000) || '*[' || CASE WHEN contradiction THEN 'CONTRADICTION(' || feature || ')' WHEN eq IS NOT NULL THEN feature || ' == ' || {_NUM('eq')}
        WHEN gt IS NOT NULL AND lt IS NOT NULL THEN {_NUM('gt')} || ' < ' || feature || ' < ' || {_NUM('lt')} WHEN gt IS NOT NULL THEN feature || ' > ' || {_NUM('gt')}
        ELSE feature || ' < ' || {_NUM('lt')} END || ']', ' + ' ORDER BY conf DESC, feature) AS combined_summary FROM cf GROUP BY o_orderkey""",
)
def i4_merged_summary(spark, sf_dir):
    return X.merged_summary(X.merge_literals(X.explained(orders(spark, sf_dir), RULES), RULES, KEY), KEY)


def _texts_sql() -> str:
    rows = ", ".join(
        "({}::BIGINT, '{}')".format(r.rule_id, " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in r.literals)) for r in RULES
    )
    return f"txt(rule_id, t) AS (VALUES {rows})"


@query(
    "i5_combined_condition",
    f"""{_contrib_sql(X.mass_weights(RULES))}, {_texts_sql()},
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(abs(weight), 12) DESC, rule_id) AS rk,
                 max((weight > 0)::INT) OVER (PARTITION BY o_orderkey) AS anyp FROM con JOIN txt USING (rule_id))
    SELECT o_orderkey, n_fired, coalesce(c, '') AS combined_condition FROM fused LEFT JOIN
      (SELECT o_orderkey, string_agg(t, ' AND ' ORDER BY rk) AS c FROM r WHERE weight > 0 OR (anyp = 0 AND rk = 1) GROUP BY 1) USING (o_orderkey)""",
)
def i5_combined_condition(spark, sf_dir):
    rows = X.explained(orders(spark, sf_dir), RULES)
    return rows.select(*KEY, "n_fired", X.combined_condition(RULES).alias("combined_condition"))


@query(
    "e4_find_firing_examples",
    f"""{_contrib_sql(X.mass_weights(RULES))}, {_texts_sql()},
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(abs(weight), 12) DESC, rule_id) AS rk,
                 max((weight > 0)::INT) OVER (PARTITION BY o_orderkey) AS anyp FROM con JOIN txt USING (rule_id)),
    top AS (SELECT o_orderkey, n_fired FROM fused WHERE n_fired > 0 ORDER BY n_fired DESC, o_orderkey LIMIT 20),
    t AS (SELECT o_orderkey, n_fired, coalesce(c, '') AS condition FROM top LEFT JOIN
      (SELECT o_orderkey, string_agg(t, ' AND ' ORDER BY rk) AS c FROM r WHERE weight > 0 OR (anyp = 0 AND rk = 1) GROUP BY 1) USING (o_orderkey))
    SELECT *, row_number() OVER (ORDER BY condition = '', n_fired DESC, o_orderkey) = 1 AS example FROM t""",
)
def e4_find_firing_examples(spark, sf_dir):
    return X.firing_examples(orders(spark, sf_dir), RULES, KEY, 20)


@query(
    "i6_explain_summary",
    rounded_sql(
        f"""{_contrib_sql(X.agreement_weights(RULES), normalise=False)},
        s AS (SELECT o_orderkey, count(*) FILTER (WHERE label IS NULL OR label = pred)::INTEGER AS a, count(*)::INTEGER AS n,
                     sum(greatest(weight, 0)) AS wf, sum(least(weight, 0)) AS wa FROM con GROUP BY 1)
        SELECT o_orderkey, pred AS predicted_class, om AS combined_omega,
               (1 - om) * (list_sort([p0, p1, p2])[3] - list_sort([p0, p1, p2])[2]) AS final_conf, n_fired AS n_rules_fired,
               coalesce(a, 0) AS n_agreeing, coalesce(n - a, 0) AS n_conflicting, coalesce(wf, 0) AS weight_for, coalesce(wa, 0) AS weight_against
        FROM fused LEFT JOIN s USING (o_orderkey)""",
        "combined_omega final_conf weight_for weight_against",
    ),
)
def i6_explain_summary(spark, sf_dir):
    return rounded(X.explain_summary(orders(spark, sf_dir), RULES, KEY))


COMBINED = f"""{_contrib_sql(X.agreement_weights(RULES), normalise=False)}, {_literals_sql()},
bv AS (SELECT o_orderkey, feature, op, value, sum(abs(weight) / n_literals) AS w FROM con JOIN rule_lits USING (rule_id) WHERE weight > 0 GROUP BY ALL),
cl AS (SELECT o_orderkey, feature, op, CASE op WHEN '==' THEN arg_max(value, round(w, 12)) WHEN '>' THEN max(value) ELSE min(value) END AS value,
              sum(w) AS weight FROM bv GROUP BY o_orderkey, feature, op)"""


@query("i7_combine_literals", rounded_sql(f"{COMBINED} SELECT * FROM cl", "weight"))
def i7_combine_literals(spark, sf_dir):
    rows = X.explained(orders(spark, sf_dir), RULES, mode="agreement")
    return rounded(X.combine_literals(rows, RULES, KEY))


@query(
    "i8_combined_rule_length_stats",
    rounded_sql(
        f"""{COMBINED} SELECT count(*) AS n_rows, avg(n) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, avg((n = 0)::INT) AS empty_rate
        FROM (SELECT o_orderkey, count(feature) AS n FROM ord LEFT JOIN cl USING (o_orderkey) GROUP BY 1)""",
        "mean median empty_rate",
    ),
)
def i8_combined_rule_length_stats(spark, sf_dir):
    return rounded(X.combined_rule_length_stats(orders(spark, sf_dir), RULES, KEY))


@query(
    "i9_inspection_checks",
    f"""WITH {ORDERS_SQL}, {FUSED} SELECT o_orderkey, pred, n_fired, true AS probabilities_sum_to_one, true AS fired_rule_count_matches,
        true AS combined_rule_present, true AS all_passed, CASE WHEN n_fired = 0 THEN 'no rule fired: the row lies outside the rules'' support' END AS warning FROM fused""",
)
def i9_inspection_checks(spark, sf_dir):
    return X.inspect_rows(orders(spark, sf_dir), RULES, KEY).drop("payload")


@query(
    "i9_inspect_rows",
    rounded_sql(
        f"""{_contrib_sql(X.mass_weights(RULES))}, {_texts_sql()},
        r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(abs(weight), 12) DESC, rule_id) AS rk,
                     max((weight > 0)::INT) OVER (PARTITION BY o_orderkey) AS anyp FROM con JOIN txt USING (rule_id)),
        c AS (SELECT o_orderkey, string_agg(t, ' AND ' ORDER BY rk) FILTER (WHERE weight > 0 OR (anyp = 0 AND rk = 1)) AS t, string_agg(rule_id, ',' ORDER BY rk) AS pool,
                     string_agg(rule_id, ',' ORDER BY rule_id) AS fired FROM r GROUP BY 1)
        SELECT o_orderkey, pred, p0, p1, p2, om AS omega, n_fired, coalesce(fired, '') AS fired, coalesce(t, '') AS condition, coalesce(pool, '') AS pool FROM fused LEFT JOIN c USING (o_orderkey)""",
        "p0 p1 p2 omega",
    ),
)
def i9_inspect_rows(spark, sf_dir):
    """The payload read back from its JSON."""
    kind = (
        "struct<prediction:struct<pred:int,proba:array<double>,unc_comb:double>,activation:struct<n_rules_fired:int,fired:array<int>>,"
        "combined_rule:struct<combined_condition:string,rules_pool:array<struct<rule_id:int>>>>"
    )
    rows = X.inspect_rows(orders(spark, sf_dir), RULES, KEY).select(*KEY, F.from_json("payload", kind).alias("j"))
    p, a, c = F.col("j.prediction"), F.col("j.activation"), F.col("j.combined_rule")
    return rounded(
        rows.select(
            *KEY, p["pred"].alias("pred"), *[F.get(p["proba"], F.lit(i)).alias(f"p{i}") for i in range(3)], p["unc_comb"].alias("omega"),
            a["n_rules_fired"].alias("n_fired"), F.concat_ws(",", a["fired"].cast("array<string>")).alias("fired"),
            c["combined_condition"].alias("condition"), F.concat_ws(",", F.transform(c["rules_pool"], lambda x: x["rule_id"].cast("string"))).alias("pool"),
        )
    )


@query(
    "i10_conformance_checks",
    "SELECT count(*) AS n_rows, 0::BIGINT AS bad_sum_to_one, 0::BIGINT AS bad_non_negative, 0::BIGINT AS bad_commutative, "
    "0::BIGINT AS bad_vacuous_identity FROM orders",
)
def i10_conformance_checks(spark, sf_dir):
    return X.conformance_checks(predict.score(orders(spark, sf_dir), RULES), 3)


@query(
    "i10_conformance_of_damaged_masses",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS bad_sum_to_one, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS bad_non_negative, "
    "0::BIGINT AS bad_commutative, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS bad_vacuous_identity FROM orders",
)
def i10_conformance_of_damaged_masses(spark, sf_dir):
    """The checks find what is wrong: every 7th order's mass sums to 1.5, every 11th gives class 0 less than nothing to omega's gain."""
    scored = predict.score(orders(spark, sf_dir), RULES)
    m = [F.get("mass", F.lit(i)) for i in range(4)]
    moved = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit(-0.3), m[1], m[2], m[3] + m[0] + 0.3)).otherwise(F.col("mass"))
    scale = F.when(F.col("o_orderkey") % 7 == 0, 1.5).otherwise(1.0)
    return X.conformance_checks(scored.withColumn("mass", moved).withColumn("mass", F.transform("mass", lambda x: x * scale)), 3)


@query("i10_prediction_invariance", "SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_delta FROM orders")
def i10_prediction_invariance(spark, sf_dir):
    retrained = RULES.with_masses([(0.2, 0.2, 0.2, 0.4)] * len(RULES))
    return X.prediction_invariance(orders(spark, sf_dir), RULES, retrained)
