"""Activation, fusion and prediction (E, F, G, I1) over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.common import (
    DEMO_RULES, LINE_OUT, LINES_SQL, ORDER_FEATURES, ORDER_RULES, ORDERS_SQL, Registry, fired_sql, fused_sql,
    lines, literal_sql, orders, rounded, rounded_sql, rule_sql, rules_sql, table, votes_sql,
)
from rulespark.functions import mass as M
from rulespark.operators import activate as A, fuse, metrics, predict
from rulespark.operators.rule_index import activate_indexed
from rulespark.rules import rules_frame

registry = Registry()
query = registry.query

OUT = ", ".join(LINE_OUT)
LINE_FUSED = fused_sql("lines", [*LINE_OUT, "l_linestatus", "y"], DEMO_RULES)
ORDER_FUSED = fused_sql("ord", ["o_orderkey", "y"], ORDER_RULES)


def spread(mass: str, n: int, prefix: str = "m", omega: bool = True) -> list:
    names = [f"{prefix}{i}" for i in range(n)] + (["om"] if omega else [])
    return [F.get(mass, F.lit(i)).alias(x) for i, x in enumerate(names)]


# ---------------------------------------------------------------- flagship


@query(
    "score_by_status",
    rounded_sql(
        f"""WITH {LINES_SQL}, {LINE_FUSED}
        SELECT l_linestatus, y, count(*) AS n, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS acc,
               avg(om) AS unc_comb, avg(unc_rule) AS unc_rule, avg(n_fired) AS depth
        FROM fused GROUP BY ALL""",
        "acc unc_comb unc_rule depth",
    ),
)
def score_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_linestatus", "y", *DEMO_RULES.features)
    scored = predict.score(rows, DEMO_RULES)
    return rounded(
        scored.groupBy("l_linestatus", "y").agg(
            F.count("*").alias("n"),
            F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"),
            F.avg("unc_comb").alias("unc_comb"),
            F.avg("unc_rule").alias("unc_rule"),
            F.avg("n_fired").alias("depth"),
        )
    )


# ---------------------------------------------------------------- E activation

LITS = sorted({lit for r in ORDER_RULES for lit in r.literals})


@query(
    "e1_eval_literals",
    f"WITH {ORDERS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{op}' AS op, {v!r}::DOUBLE AS value, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE {literal_sql(f, op, v)}) AS n_true FROM ord"
        for f, op, v in LITS
    ),
)
def e1_eval_literals(spark, sf_dir):
    truth = A.literal_truth(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"])
    return truth.groupBy("feature", "op", "value").agg(F.count("*").alias("n_rows"), F.count_if("holds").alias("n_true"))


FIRED_ORDERS = f"WITH {ORDERS_SQL}, {fired_sql('ord', ['o_orderkey'], ORDER_RULES)} SELECT * FROM fired"


@query("e2_activate_columns", FIRED_ORDERS)
def e2_activate_columns(spark, sf_dir):
    return A.activate(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"], form="columns")


@query("e2_activate_batches", FIRED_ORDERS)
def e2_activate_batches(spark, sf_dir):
    return A.activate(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"], form="batches")


@query("e2_activate_relational", FIRED_ORDERS)
def e2_activate_relational(spark, sf_dir):
    return A.activate_relational(orders(spark, sf_dir), rules_frame(spark, ORDER_RULES), ["o_orderkey"], ORDER_FEATURES)


@query(
    "e2_activate_indexed",
    """WITH p AS (SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, (min(l_discount) + max(l_discount)) / 2 AS disc, max(l_quantity) AS qty FROM lineitem GROUP BY 1)
        SELECT p.l_partkey AS rule_id, count(*) AS rows, sum(l_quantity)::BIGINT AS quantity FROM p JOIN lineitem l
        ON l_extendedprice > low AND l_extendedprice < high AND l_discount > disc
           AND abs(l_quantity - qty) <= 1e-5 + 1e-5 * abs(qty) GROUP BY 1""",
)
def e2_activate_indexed(spark, sf_dir):
    """A rule per part, made of its lines' prices, middle discount and greatest quantity, matched with every line item."""
    items = table(spark, sf_dir, "lineitem")
    part = items.groupBy("l_partkey").agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), ((F.min("l_discount") + F.max("l_discount")) / 2).alias("disc"), F.max("l_quantity").cast("double").alias("qty")
    )
    literal = lambda f, op, v: F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), F.col(v).cast("double").alias("value"))
    literals = [("l_extendedprice", ">", "low"), ("l_extendedprice", "<", "high"), ("l_discount", ">", "disc"), ("l_quantity", "==", "qty")]
    rules = part.select(F.col("l_partkey").alias("rule_id"), F.array(*[literal(*lit) for lit in literals]).alias("literals"))
    keyed = items.withColumn("quantity", F.col("l_quantity").cast("long"))
    return activate_indexed(keyed, rules, ["quantity"], ["l_extendedprice", "l_discount", "l_quantity"], totals=True)


@query(
    "e2_activate_lineitem",
    f"WITH {LINES_SQL}, {fired_sql('lines', 'y', DEMO_RULES)} SELECT rule_id, count(*) FILTER (WHERE y = 1) AS support, "
    "count(*) FILTER (WHERE y = 0) AS neg_covered FROM fired GROUP BY ALL",
)
def e2_activate_lineitem(spark, sf_dir):
    return A.rule_counts(lines(spark, sf_dir), DEMO_RULES, positive=F.col("y") == 1)


@query(
    "e3_fired_rules_for_row",
    f"WITH {ORDERS_SQL}, {rules_sql(ORDER_RULES)}, {fired_sql('ord', ['o_orderkey'], ORDER_RULES)} "
    "SELECT o_orderkey, count(rule_id)::INTEGER AS n_fired, coalesce(string_agg(caption, ' ; ' ORDER BY rule_id), '') AS captions "
    "FROM ord LEFT JOIN (SELECT * FROM fired JOIN rules USING (rule_id)) f USING (o_orderkey) GROUP BY ALL",
)
def e3_fired_rules_for_row(spark, sf_dir):
    return A.fired_overview(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"])


# ---------------------------------------------------------------- F fusion


def _half(spark, sf_dir, ids):
    """Fused masses of one half of the order rules for every order: one input of the pairwise combination."""
    from dataclasses import replace

    part = replace(ORDER_RULES, rules=tuple(r for r in ORDER_RULES if r.rule_id in ids))
    return predict.score(orders(spark, sf_dir), part).select("o_orderkey", "mass")


@query(
    "f1_combine_evidence",
    rounded_sql(f"WITH {ORDERS_SQL}, {ORDER_FUSED} SELECT o_orderkey, m0, m1, m2, om FROM fused", "m0 m1 m2 om"),
)
def f1_combine_evidence(spark, sf_dir):
    left, right = _half(spark, sf_dir, range(0, 4)), _half(spark, sf_dir, range(4, 9))
    both = fuse.combine_evidence(left, right, ["o_orderkey"], 3)
    return rounded(both.select("o_orderkey", *spread("mass", 3)))


LINE_MASS = rounded_sql(
    f"WITH {LINES_SQL}, {LINE_FUSED} SELECT {OUT}, n_fired, m0, m1, om FROM fused", "m0 m1 om"
)


@query("f2_fuse_dempster", LINE_MASS)
def f2_fuse_dempster(spark, sf_dir):
    out = predict.score(lines(spark, sf_dir), DEMO_RULES)
    return rounded(out.select(*LINE_OUT, "n_fired", *spread("mass", 2)))


@query("f2_fuse_dempster_batches", LINE_MASS)
def f2_fuse_dempster_batches(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*LINE_OUT, *DEMO_RULES.features)
    return rounded(predict.score(rows, DEMO_RULES, form="batches").select(*LINE_OUT, "n_fired", *spread("mass", 2)))


@query(
    "f2_fuse_dempster_grouped",
    rounded_sql(
        f"WITH {ORDERS_SQL}, {rules_sql(ORDER_RULES)}, {fired_sql('ord', ['o_orderkey'], ORDER_RULES)}, "
        "a AS (SELECT o_orderkey, count(*) AS n_fired, avg(om) AS unc_rule, product(m0 + om) AS q0, product(m1 + om) AS q1, "
        "product(m2 + om) AS q2, product(om) AS q FROM fired JOIN rules USING (rule_id) GROUP BY ALL) "
        "SELECT o_orderkey, n_fired, unc_rule, (q0 - q) / z AS m0, (q1 - q) / z AS m1, (q2 - q) / z AS m2, q / z AS om "
        "FROM (SELECT *, q0 + q1 + q2 - 2 * q AS z FROM a)",
        "unc_rule m0 m1 m2 om",
    ),
)
def f2_fuse_dempster_grouped(spark, sf_dir):
    fired = A.activate(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"])
    out = fuse.fuse_grouped(fired, rules_frame(spark, ORDER_RULES), ["o_orderkey"], 3)
    return rounded(out.select("o_orderkey", "n_fired", "unc_rule", *spread("mass", 3)))


def _yager_step(i: int) -> str:
    """One fold step of the K=2 Yager combination in SQL, for rule i of the demo set."""
    r = DEMO_RULES.rules[i]
    b0, b1, bo = (f"{v!r}::DOUBLE" for v in r.mass)
    new = {
        "a0": f"a0 * {b0} + a0 * {bo} + ao * {b0}",
        "a1": f"a1 * {b1} + a1 * {bo} + ao * {b1}",
        "ao": f"ao * {bo} + a0 * {b1} + a1 * {b0}",
    }
    swaps = ", ".join(f"CASE WHEN {rule_sql(r)} THEN {e} ELSE {c} END AS {c}" for c, e in new.items())
    return f"y{i + 1} AS (SELECT * REPLACE ({swaps}) FROM y{i})"


YAGER_CTES = ", ".join(
    ["y0 AS (SELECT *, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS ao FROM lines)"]
    + [_yager_step(i) for i in range(len(DEMO_RULES))]
)


@query(
    "f3_fuse_yager",
    rounded_sql(
        f"WITH {LINES_SQL}, {YAGER_CTES} SELECT {OUT}, a0 AS m0, a1 AS m1, ao AS om FROM y{len(DEMO_RULES)}", "m0 m1 om", 10
    ),
)
def f3_fuse_yager(spark, sf_dir):
    out = fuse.fuse_yager(lines(spark, sf_dir), DEMO_RULES)
    return rounded(out.select(*LINE_OUT, *spread("yager", 2)), 10)


ORDER_VOTES = votes_sql("ord", ["o_orderkey", "y"], ORDER_RULES)


@query(
    "f4_fuse_vote",
    rounded_sql(
        f"WITH {ORDERS_SQL}, {ORDER_VOTES} SELECT o_orderkey, "
        + ", ".join(f"CASE WHEN v0+v1+v2 > 0 THEN v{c} / (v0+v1+v2) ELSE 0.0 END AS m{c}" for c in range(3))
        + ", CASE WHEN v0+v1+v2 > 0 THEN 0.0 ELSE 1.0 END AS om FROM voted",
        "m0 m1 m2 om",
    ),
)
def f4_fuse_vote(spark, sf_dir):
    out = fuse.with_evidence(orders(spark, sf_dir), ORDER_RULES).withColumn("mass", F.array(*fuse.vote_vec(3)))
    return rounded(out.select("o_orderkey", *spread("mass", 3)))


def _mass_source() -> str:
    """Unnormalised parameters per nation of the customers: balances by sign, a table that grows with the data."""
    return (
        "src AS (SELECT c_custkey, greatest(c_acctbal, 0) / 1000 AS a, greatest(-c_acctbal, 0) / 100 AS b, "
        "1.0 + c_nationkey / 10 AS c FROM customer)"
    )


def _mass_frame(spark, sf_dir):
    from catalog.common import table

    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array(F.greatest(bal, F.lit(0)) / 1000, F.greatest(-bal, F.lit(0)) / 100, 1.0 + F.col("c_nationkey") / 10).alias("mass"),
    )


def _logit_sql(a: str, b: str, c: str) -> str:
    logs = [f"ln(greatest({x}, 1e-8))" for x in (a, b, c)]
    centre = f"(({' + '.join(logs)}) / 3)"
    return ", ".join(f"least(greatest({x} - {centre}, -12), 12) AS g{i}" for i, x in enumerate(logs))


@query(
    "f5_normalise_mass_table",
    rounded_sql(
        f"WITH {_mass_source()}, n AS (SELECT c_custkey, greatest(a, 1e-8) AS a, greatest(b, 1e-8) AS b, greatest(c, 1e-8) AS c FROM src), "
        "d AS (SELECT c_custkey, a / (a+b+c) AS m0, b / (a+b+c) AS m1, c / (a+b+c) AS om FROM n) "
        f"SELECT *, {_logit_sql('m0', 'm1', 'om')} FROM d",
        "m0 m1 om g0 g1 g2",
    ),
)
def f5_normalise_mass_table(spark, sf_dir):
    out = fuse.normalise_mass_table(_mass_frame(spark, sf_dir), 2)
    return rounded(out.select("c_custkey", *spread("mass", 2), *spread("logits", 3, "g", omega=False)))


@query(
    "f5_softmax_logits",
    rounded_sql(
        f"WITH {_mass_source()}, e AS (SELECT c_custkey, exp(a - t) AS a, exp(b - t) AS b, exp(c - t) AS c FROM "
        "(SELECT *, greatest(a, b, c) AS t FROM src)) "
        "SELECT c_custkey, a / (a+b+c) AS m0, b / (a+b+c) AS m1, c / (a+b+c) AS om FROM e",
        "m0 m1 om",
    ),
)
def f5_softmax_logits(spark, sf_dir):
    out = fuse.normalise_mass_table(_mass_frame(spark, sf_dir), 2, source="logits")
    return rounded(out.select("c_custkey", *spread("mass", 2)))


@query(
    "f6_pignistic",
    rounded_sql(f"WITH {LINES_SQL}, {LINE_FUSED} SELECT {OUT}, p0, p1 FROM fused", "p0 p1"),
)
def f6_pignistic(spark, sf_dir):
    out = predict.score(lines(spark, sf_dir), DEMO_RULES)
    return rounded(out.select(*LINE_OUT, *spread("proba", 2, "p", omega=False)))


# Inverse-count class prior of the order bands, computed on the whole table in both engines.
PRIOR_SQL = (
    "pr AS (SELECT max(w) FILTER (WHERE y = 0) / sum(w) AS r0, max(w) FILTER (WHERE y = 1) / sum(w) AS r1, "
    "max(w) FILTER (WHERE y = 2) / sum(w) AS r2 FROM (SELECT y, 1.0 / count(*) AS w FROM ord GROUP BY y))"
)


def _prior_columns(base: DataFrame) -> list:
    """The class prior as scalar subqueries: one small aggregate, no join."""
    prior = predict.class_prior(base)
    return [prior.where(F.col("y") == c).select(F.max("prior")).scalar() for c in range(3)]


PRIOR_FUSED = f"""WITH {ORDERS_SQL}, {ORDER_FUSED}, {PRIOR_SQL},
w AS (SELECT o_orderkey, om, m0 + om * r0 AS a0, m1 + om * r1 AS a1, m2 + om * r2 AS a2 FROM fused CROSS JOIN pr),
b AS (SELECT o_orderkey, om, a0/(a0+a1+a2) AS b0, a1/(a0+a1+a2) AS b1, a2/(a0+a1+a2) AS b2 FROM w)"""


@query("f7_pignistic_prior", rounded_sql(f"{PRIOR_FUSED} SELECT o_orderkey, b0, b1, b2 FROM b", "b0 b1 b2"))
def f7_pignistic_prior(spark, sf_dir):
    base = orders(spark, sf_dir)
    out = predict.score(base, ORDER_RULES).select("o_orderkey", "mass", F.array(*_prior_columns(base)).alias("prior"))
    vec = M.pignistic_prior(M.unpack(F.col("mass"), 4), M.unpack(F.col("prior"), 3))
    return rounded(out.select("o_orderkey", *[v.alias(f"b{i}") for i, v in enumerate(vec)]))


@query(
    "f8_final_confidence",
    rounded_sql(
        f"""{PRIOR_FUSED} SELECT o_orderkey, 1 - om AS certainty, s AS separation, (1 - om) * greatest(s, 0) AS final_conf
        FROM (SELECT *, list_sort([b0, b1, b2])[3] - list_sort([b0, b1, b2])[2] AS s FROM b)""",
        "certainty separation final_conf",
    ),
)
def f8_final_confidence(spark, sf_dir):
    base = orders(spark, sf_dir)
    out = predict.score(base, ORDER_RULES).select("o_orderkey", "mass", F.array(*_prior_columns(base)).alias("prior"))
    parts = M.final_confidence(M.unpack(F.col("mass"), 4), M.unpack(F.col("prior"), 3))
    return rounded(out.select("o_orderkey", *[parts[c].alias(c) for c in ("certainty", "separation", "final_conf")]))


# ---------------------------------------------------------------- G prediction


@query(
    "g1_predict",
    rounded_sql(f"WITH {ORDERS_SQL}, {ORDER_FUSED} SELECT o_orderkey, p0, p1, p2, pred FROM fused", "p0 p1 p2"),
)
def g1_predict(spark, sf_dir):
    out = predict.score(orders(spark, sf_dir), ORDER_RULES)
    return rounded(out.select("o_orderkey", *spread("proba", 3, "p", omega=False), "pred"))


@query(
    "g2_predict_first_rule",
    f"WITH {ORDERS_SQL}, {ORDER_VOTES} SELECT o_orderkey, coalesce(first_label, 1) AS pred FROM voted",
)
def g2_predict_first_rule(spark, sf_dir):
    return predict.predict_first_rule(orders(spark, sf_dir), ORDER_RULES).select("o_orderkey", "pred")


@query(
    "g3_first_hit_proba",
    rounded_sql(
        f"WITH {ORDERS_SQL}, {ORDER_VOTES}, f AS (SELECT o_orderkey, coalesce(first_label, 1) AS c FROM voted) SELECT o_orderkey, "
        + ", ".join(f"(CASE WHEN c = {i} THEN 0.9::DOUBLE ELSE 0.1::DOUBLE / 3 END) / (0.9::DOUBLE + 0.2::DOUBLE / 3) AS p{i}" for i in range(3))
        + " FROM f",
        "p0 p1 p2",
    ),
)
def g3_first_hit_proba(spark, sf_dir):
    out = predict.predict_first_rule(orders(spark, sf_dir), ORDER_RULES)
    vec = predict.first_hit_vec(F.col("pred"), 3)
    return rounded(out.select("o_orderkey", *[v.alias(f"p{i}") for i, v in enumerate(vec)]))


@query("g4_predict_vote", f"WITH {ORDERS_SQL}, {ORDER_VOTES} SELECT o_orderkey, vote AS pred FROM voted")
def g4_predict_vote(spark, sf_dir):
    return predict.predict_vote(orders(spark, sf_dir), ORDER_RULES).select("o_orderkey", "pred")


@query(
    "g5_class_prior",
    rounded_sql(
        f"WITH {ORDERS_SQL}, c AS (SELECT y, count(*) AS n FROM ord GROUP BY y), t AS (SELECT sum(n) AS s FROM c) "
        "SELECT y, n, (1.0 / n) / (SELECT sum(1.0 / n) FROM c) AS inverse, "
        "pow(s / n, 0.75) / (SELECT sum(pow(s / n, 0.75)) FROM c, t) AS powered FROM c, t",
        "inverse powered",
    ),
)
def g5_class_prior(spark, sf_dir):
    base = orders(spark, sf_dir)
    inverse = predict.class_prior(base).withColumnRenamed("prior", "inverse")
    powered = predict.class_prior(base, power=0.25).select("y", F.col("prior").alias("powered"))
    return rounded(inverse.join(powered, "y"))


@query(
    "h5_class_weights",
    rounded_sql(
        f"WITH {LINES_SQL} SELECT y, count(*) AS n, pow(sum(count(*)) OVER () / count(*), 0.5) AS weight FROM lines GROUP BY y", "weight"
    ),
)
def h5_class_weights(spark, sf_dir):
    return rounded(predict.class_weights(lines(spark, sf_dir)))


@query(
    "i1_uncertainty_stats",
    rounded_sql(f"WITH {LINES_SQL}, {LINE_FUSED} SELECT {OUT}, unc_rule, om AS unc_comb FROM fused", "unc_rule unc_comb"),
)
def i1_uncertainty_stats(spark, sf_dir):
    out = predict.score(lines(spark, sf_dir), DEMO_RULES)
    return rounded(out.select(*LINE_OUT, "unc_rule", "unc_comb"))


# ---------------------------------------------------------------- J metrics

SCORED = f"WITH {ORDERS_SQL}, {ORDER_FUSED}"
CLIPPED = """, c AS (SELECT y, pred, greatest(p0, 1e-12) AS a, greatest(p1, 1e-12) AS b, greatest(p2, 1e-12) AS d FROM fused),
pr AS (SELECT y, pred, a / (a+b+d) AS a, b / (a+b+d) AS b, d / (a+b+d) AS d FROM c),
x AS (SELECT y, pred, greatest(a, b, d) AS conf, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE d END AS py FROM pr)"""
PER_CLASS = """, k AS (SELECT unnest([0, 1, 2]) AS label),
cls AS (SELECT label, sum((y = label)::INT)::BIGINT AS n_true, sum((pred = label)::INT)::BIGINT AS n_pred,
               sum((y = label AND pred = label)::INT)::BIGINT AS tp FROM fused, k GROUP BY label),
sc AS (SELECT label, n_true, n_pred, tp, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
              CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS recall,
              CASE WHEN n_true + n_pred > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0 END AS f1 FROM cls)"""
LEFT_BIN = " + ".join(f"(conf >= {i / 15!r}::DOUBLE)::INT" for i in range(1, 15))
RIGHT_BIN = " + ".join(f"(conf > {i / 15!r}::DOUBLE)::INT" for i in range(1, 15))


def ece_sql(bin_expr: str, hit: str = "pred = y") -> str:
    return (
        f"SELECT sum(abs(acc - conf) * n) / sum(n) AS ece FROM (SELECT {bin_expr} AS bin, count(*) AS n, "
        f"avg(({hit})::INT) AS acc, avg(conf) AS conf FROM x GROUP BY 1)"
    )


def scored_orders(spark, sf_dir):
    return predict.score(orders(spark, sf_dir), ORDER_RULES)


@query("j1_confusion", f"{SCORED} SELECT y, pred, count(*) AS n FROM fused GROUP BY ALL")
def j1_confusion(spark, sf_dir):
    return metrics.confusion(scored_orders(spark, sf_dir))


@query("j1_class_report", rounded_sql(f"{SCORED}{PER_CLASS} SELECT * FROM sc", "precision recall f1"))
def j1_class_report(spark, sf_dir):
    return rounded(metrics.class_report(scored_orders(spark, sf_dir), 3))


@query(
    "j1_weighted_average",
    rounded_sql(
        f"{SCORED}{PER_CLASS} SELECT sum(n_true)::BIGINT AS n_rows, sum(tp) / sum(n_true) AS acc, sum(f1 * n_true) / sum(n_true) AS macro_f1, "
        "sum(precision * n_true) / sum(n_true) AS precision, sum(recall * n_true) / sum(n_true) AS recall FROM sc",
        "acc macro_f1 precision recall",
    ),
)
def j1_weighted_average(spark, sf_dir):
    return rounded(metrics.summarise(scored_orders(spark, sf_dir), 3, average="weighted"))


@query("j2_nll", rounded_sql(f"{SCORED}{CLIPPED} SELECT avg(-ln(py)) AS nll FROM x", "nll"))
def j2_nll(spark, sf_dir):
    return rounded(metrics.nll(scored_orders(spark, sf_dir), 3))


@query("j3_ece_left", rounded_sql(f"{SCORED}{CLIPPED} {ece_sql(LEFT_BIN)}", "ece"))
def j3_ece_left(spark, sf_dir):
    return rounded(metrics.ece(scored_orders(spark, sf_dir), 3, pred="pred"))


@query("j4_ece_right", rounded_sql(f"{SCORED}{CLIPPED} {ece_sql(RIGHT_BIN)}", "ece"))
def j4_ece_right(spark, sf_dir):
    return rounded(metrics.ece(scored_orders(spark, sf_dir), 3, closed="right"))


@query(
    "j5_compute_metrics",
    rounded_sql(
        f"{SCORED}{CLIPPED}{PER_CLASS} SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT avg((pred = y)::INT) FROM x) AS acc, "
        "avg(f1) AS macro_f1, avg(precision) AS precision, avg(recall) AS recall, "
        f"({ece_sql(LEFT_BIN)}) AS ece, (SELECT avg(-ln(py)) FROM x) AS nll, (SELECT avg(unc_rule) FROM fused) AS unc_rule, "
        "(SELECT avg(om) FROM fused) AS unc_comb, (SELECT avg(n_fired) FROM fused) AS fusion_depth FROM sc WHERE n_true + n_pred > 0",
        "acc macro_f1 precision recall ece nll unc_rule unc_comb fusion_depth",
    ),
)
def j5_compute_metrics(spark, sf_dir):
    return rounded(metrics.compute_metrics(scored_orders(spark, sf_dir), 3))


@query(
    "j7_top2_margin",
    rounded_sql(f"{SCORED} SELECT o_orderkey, list_sort([p0,p1,p2])[3] - list_sort([p0,p1,p2])[2] AS margin FROM fused", "margin"),
)
def j7_top2_margin(spark, sf_dir):
    out = scored_orders(spark, sf_dir)
    return rounded(out.select("o_orderkey", M.top2_margin(M.unpack(F.col("proba"), 3)).alias("margin")))
