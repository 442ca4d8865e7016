"""Hard-case queries (K) over every order; data sets are the order statuses.

The baseline here is a fixed price rule so that SQL can recompute every figure; the trained forest is
`g6_random_forest_baseline`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import ORDER_RULES, ORDERS_SQL, Registry, fired_sql, fused_sql, orders, rounded, rounded_sql, rule_sql, rules_sql, votes_sql
from rulespark.operators import hardcases as H
from rulespark.operators.explain import vote_strength

registry = Registry()
query = registry.query
KEY = ["o_orderkey"]
R = ORDER_RULES


def samples_input(spark, sf_dir):
    price = F.col("o_totalprice")
    base = F.when(price < 100000, 0).when(price < 240000, 1).otherwise(2)
    proba = F.array(*[F.when(base == c, 0.7 + 0.05 * c).otherwise((0.3 - 0.05 * F.col("rf_pred")) / 2) for c in range(3)])
    rows = orders(spark, sf_dir).withColumn("dataset", F.concat(F.lit("status"), F.col("status").cast("int")))
    return rows.withColumn("algo", F.lit("FOIL")).withColumn("rf_pred", base).withColumn("rf_proba", proba)


def flagged(spark, sf_dir):
    return H.hard_flags(H.hard_case_samples(samples_input(spark, sf_dir), R, KEY))


def _sum_sql(value) -> str:
    terms = [f"(CASE WHEN {rule_sql(r)} THEN {value(r)!r}::DOUBLE ELSE 0.0::DOUBLE END)" for r in R if value(r)]
    return " + ".join(terms) or "0.0::DOUBLE"


SUPPORT_CTE = (
    "sup AS (SELECT o_orderkey, status, y, o_totalprice, "
    + ", ".join(f"{_sum_sql(lambda r, c=c: vote_strength(r, 3) if r.label == c else 0.0)} AS s{c}" for c in range(3))
    + ", "
    + ", ".join(f"{_sum_sql(lambda r, c=c: r.mass[c])} AS d{c}" for c in range(3))
    + " FROM ord)"
)


def _true(p: str) -> str:
    return f"CASE y WHEN 0 THEN {p}0 WHEN 1 THEN {p}1 ELSE {p}2 END"


def _wrong(p: str) -> str:
    return f"CASE y WHEN 0 THEN greatest({p}1, {p}2) WHEN 1 THEN greatest({p}0, {p}2) ELSE greatest({p}0, {p}1) END"


def _margin(a: str, b: str, c: str) -> str:
    return f"list_sort([{a}, {b}, {c}])[3] - list_sort([{a}, {b}, {c}])[2]"


SAMPLES = f"""WITH {ORDERS_SQL}, {fused_sql('ord', ['o_orderkey'], R)}, {votes_sql('ord', ['o_orderkey'], R)}, {SUPPORT_CTE},
j AS (SELECT sup.*, v0, v1, v2, f.n_fired, coalesce(first_label, 1) AS first, vote, pred, p0, p1, p2, om, greatest(v0 + v1 + v2, 1) AS vt,
             CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 240000 THEN 1 ELSE 2 END AS rf
      FROM sup JOIN fused f USING (o_orderkey) JOIN voted v USING (o_orderkey)),
samples AS (SELECT 'status' || status::INT AS dataset, 'FOIL' AS algo, o_orderkey, n_fired AS n_rules_fired,
   (v0 > 0)::INT + (v1 > 0)::INT + (v2 > 0)::INT AS n_distinct_rule_labels, (v0 + v1 + v2)::INT AS labeled_rule_count,
   ({_true('v')})::INT AS true_rule_count, ({_wrong('v')})::INT AS max_wrong_rule_count, (v0 + v1 + v2 - ({_true('v')}))::INT AS wrong_rule_count_total,
   {_true('s')} AS true_raw_vote_strength, {_wrong('s')} AS max_wrong_raw_vote_strength,
   {_true('d')} AS true_dsgd_support_sum, {_wrong('d')} AS max_wrong_dsgd_support_sum,
   first AS pred_first_hit_laplace, vote AS pred_weighted_vote, pred AS pred_dsgd_dempster, rf AS pred_rf, y AS true_label,
   CASE WHEN v0 + v1 + v2 = 0 THEN 0.0 ELSE {_margin('v0/vt', 'v1/vt', 'v2/vt')} END AS weighted_vote_margin,
   {_margin('p0', 'p1', 'p2')} AS dsgd_margin, 0.7 + 0.05 * rf - (0.3 - 0.05 * rf) / 2 AS rf_margin, om AS unc_comb_dempster,
   first = y AS first_hit_correct, vote = y AS weighted_vote_correct, pred = y AS dsgd_dempster_correct, rf = y AS rf_correct,
   first <> y AS first_hit_wrong, vote <> y AS weighted_vote_wrong, vote <> y AND pred = y AS weighted_vote_fixed_by_dsgd,
   first <> y AND pred = y AS first_hit_fixed_by_dsgd, vote = y AND pred <> y AS weighted_vote_broken_by_dsgd FROM j)"""

FLAGGED = f"""{SAMPLES}, lim AS (SELECT dataset, greatest(3, ceil(quantile_cont(n_rules_fired, 0.75)))::INTEGER AS depth_threshold FROM samples GROUP BY 1),
fl AS (SELECT samples.*, depth_threshold, n_distinct_rule_labels >= 2 AS disagreement, n_rules_fired >= depth_threshold AS high_depth,
   weighted_vote_margin <= 0.15 AS low_weighted_margin,
   true_rule_count >= 1 AND max_wrong_rule_count - true_rule_count >= 1 AS minority_true_rule_support,
   true_rule_count = 1 AND max_wrong_rule_count >= 2 AS one_true_many_wrong FROM samples JOIN lim USING (dataset))"""
_COUNT = " + ".join(f"{f}::INT" for f in H.FLAGS)
_REASONS = "concat_ws('|', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in H.FLAGS) + ")"
HARD = f"""{FLAGGED}, hard AS (SELECT *, {_COUNT} AS hard_case_flag_count, {_REASONS} AS hard_case_reasons FROM fl
WHERE ({_COUNT}) >= 1 OR one_true_many_wrong)"""
SAMPLE_DOUBLES = (
    "true_raw_vote_strength max_wrong_raw_vote_strength true_dsgd_support_sum max_wrong_dsgd_support_sum weighted_vote_margin "
    "dsgd_margin rf_margin unc_comb_dempster"
)


@query("k1_class_support", rounded_sql(f"{SAMPLES} SELECT * FROM samples", SAMPLE_DOUBLES))
def k1_class_support(spark, sf_dir):
    return rounded(H.hard_case_samples(samples_input(spark, sf_dir), R, KEY))


@query(
    "k2_hard_flags",
    f"{FLAGGED} SELECT o_orderkey, dataset, depth_threshold, {', '.join(H.FLAGS)} FROM fl",
)
def k2_hard_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("o_orderkey", "dataset", "depth_threshold", *H.FLAGS)


@query(
    "k3_hard_case_base",
    f"{HARD} SELECT o_orderkey, dataset, algo, hard_case_flag_count, hard_case_reasons FROM hard",
)
def k3_hard_case_base(spark, sf_dir):
    return H.hard_case_base(flagged(spark, sf_dir)).select("o_orderkey", "dataset", "algo", "hard_case_flag_count", "hard_case_reasons")


def _bucket_tests() -> dict[str, str]:
    return {
        "all_test": "true", **{f: f for f in H.FLAGS}, "weighted_vote_wrong": "weighted_vote_wrong",
        "weighted_vote_wrong_and_disagreement": "weighted_vote_wrong AND disagreement",
        "weighted_vote_fixed_by_dsgd": "weighted_vote_fixed_by_dsgd", "first_hit_fixed_by_dsgd": "first_hit_fixed_by_dsgd",
    }


def _quality_sql(m: str, col: str) -> str:
    tp = lambda c: f"count(*) FILTER (WHERE {col} = {c} AND true_label = {c})"
    t = lambda c: f"count(*) FILTER (WHERE true_label = {c})"
    p = lambda c: f"count(*) FILTER (WHERE {col} = {c})"
    mean = lambda f: "(" + " + ".join(f(c) for c in range(3)) + ") / 3"
    return (
        f"avg(({col} = true_label)::INT) AS {m}_acc, "
        f"{mean(lambda c: f'coalesce(2.0 * {tp(c)} / nullif({t(c)} + {p(c)}, 0), 0)')} AS {m}_macro_f1, "
        f"{mean(lambda c: f'coalesce({tp(c)} / nullif({p(c)}, 0), 0)')} AS {m}_precision, "
        f"{mean(lambda c: f'coalesce({tp(c)} / nullif({t(c)}, 0), 0)')} AS {m}_recall"
    )


BUCKETS = (
    f"{FLAGGED}, bk AS ("
    + " UNION ALL ".join(f"SELECT '{b}' AS bucket, * FROM fl WHERE {t}" for b, t in _bucket_tests().items())
    + "), q AS (SELECT dataset, algo, bucket, count(*) AS n_samples, "
    + ", ".join(_quality_sql(m, c) for m, c in H._PREDS.items())
    + ", count(*) FILTER (WHERE weighted_vote_fixed_by_dsgd) AS weighted_vote_fix_count, count(*) FILTER (WHERE weighted_vote_broken_by_dsgd) AS weighted_vote_break_count"
    + ", count(*) FILTER (WHERE first_hit_fixed_by_dsgd) AS first_hit_fix_count, count(*) FILTER (WHERE first_hit_correct AND NOT dsgd_dempster_correct) AS first_hit_break_count, "
    + ", ".join(f"avg({c}) AS {name}" for name, c in H._MEANS.items())
    + " FROM bk GROUP BY ALL), tot AS (SELECT dataset, n_samples AS t FROM q WHERE bucket = 'all_test'),"
    + " bs AS (SELECT q.* EXCLUDE (first_hit_precision, first_hit_recall, rf_precision, rf_recall), n_samples / t AS share_of_test, "
    + ", ".join(f"dsgd_dempster_{k} - weighted_vote_{k} AS delta_{k}_vs_weighted" for k in ("acc", "macro_f1", "precision", "recall"))
    + ", "
    + ", ".join(f"rf_{k} - weighted_vote_{k} AS delta_rf_{k}_vs_weighted" for k in ("acc", "macro_f1"))
    + ", "
    + ", ".join(f"dsgd_dempster_{k} - rf_{k} AS delta_dsgd_{k}_vs_rf" for k in ("acc", "macro_f1"))
    + " FROM q JOIN tot USING (dataset))"
)
BUCKET_DOUBLES = " ".join(
    ["share_of_test"]
    + [f"{m}_{k}" for m in ("weighted_vote", "dsgd_dempster") for k in ("acc", "macro_f1", "precision", "recall")]
    + [f"{m}_{k}" for m in ("first_hit", "rf") for k in ("acc", "macro_f1")]
    + [f"delta_{k}_vs_weighted" for k in ("acc", "macro_f1", "precision", "recall")]
    + [f"delta_rf_{k}_vs_weighted" for k in ("acc", "macro_f1")] + [f"delta_dsgd_{k}_vs_rf" for k in ("acc", "macro_f1")]
    + list(H._MEANS)
)


@query("k4_bucket_summary", rounded_sql(f"{BUCKETS} SELECT * FROM bs", BUCKET_DOUBLES))
def k4_bucket_summary(spark, sf_dir):
    return rounded(H.bucket_summary(flagged(spark, sf_dir), 3))


@query(
    "k5_bucket_profile",
    rounded_sql(
        f"{BUCKETS} SELECT algo, bucket, " + ", ".join(f"avg({c}) AS {c}_mean" for c in H.PROFILE_COLUMNS) + " FROM bs GROUP BY ALL",
        " ".join(f"{c}_mean" for c in H.PROFILE_COLUMNS),
    ),
)
def k5_bucket_profile(spark, sf_dir):
    return rounded(H.bucket_profile(H.bucket_summary(flagged(spark, sf_dir), 3)))


@query(
    "k6_hard_base_overview",
    rounded_sql(
        f"{HARD} SELECT dataset, algo, count(*) AS n_hard_cases, " + ", ".join(f"avg({c}::DOUBLE) AS {n}" for n, c in H._OVERVIEW.items())
        + " FROM hard GROUP BY ALL",
        " ".join(H._OVERVIEW),
    ),
)
def k6_hard_base_overview(spark, sf_dir):
    return rounded(H.hard_base_overview(H.hard_case_base(flagged(spark, sf_dir))))


METHOD_ROWS = " UNION ALL ".join(
    f"SELECT dataset, algo, '{m}' AS method, true_label AS y, {p} AS pred FROM hard" for m, p in H.METHOD_PREDICTIONS.items()
)


@query(
    "k7_hard_base_method_summary",
    rounded_sql(
        f"""{HARD}, mr AS ({METHOD_ROWS}), k AS (SELECT unnest([0, 1, 2]) AS c),
        pc AS (SELECT dataset, algo, method, c, count(*) FILTER (WHERE y = c) AS t, count(*) FILTER (WHERE pred = c) AS p,
                      count(*) FILTER (WHERE y = c AND pred = c) AS tp FROM mr, k GROUP BY ALL)
        SELECT a.dataset, a.algo, a.method, n_rows, acc, macro_f1, precision, recall FROM
          (SELECT dataset, algo, method, count(*) AS n_rows, avg((y = pred)::INT) AS acc FROM mr GROUP BY ALL) a JOIN
          (SELECT dataset, algo, method, avg(2.0 * tp / (t + p)) AS macro_f1, avg(coalesce(tp / nullif(p, 0), 0)) AS precision, avg(tp / t) AS recall
           FROM pc WHERE t > 0 GROUP BY ALL) b USING (dataset, algo, method)""",
        "acc macro_f1 precision recall",
    ),
)
def k7_hard_base_method_summary(spark, sf_dir):
    return rounded(H.hard_base_method_summary(H.hard_case_base(flagged(spark, sf_dir)), 3))


@query(
    "k8_select_examples",
    rounded_sql(
        f"""{FLAGGED} SELECT o_orderkey, max_wrong_rule_count, n_rules_fired, weighted_vote_margin, dsgd_margin FROM fl
        WHERE weighted_vote_wrong AND dsgd_dempster_correct AND disagreement
        ORDER BY max_wrong_rule_count DESC, n_rules_fired DESC, round(weighted_vote_margin, 9), round(dsgd_margin, 9) DESC, o_orderkey LIMIT 25""",
        "weighted_vote_margin dsgd_margin",
    ),
)
def k8_select_examples(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    rows = rows.withColumn("weighted_vote_margin", F.round("weighted_vote_margin", 9)).withColumn("dsgd_margin", F.round("dsgd_margin", 9))
    out = H.select_examples(rows, KEY, 25)
    return rounded(out.select("o_orderkey", "max_wrong_rule_count", "n_rules_fired", "weighted_vote_margin", "dsgd_margin"))


def _top_sql(score: str, match: str) -> str:
    return f"coalesce(arg_max(caption, {score} * 1e6 - f.rule_id * 1e-6) FILTER (WHERE label {match} y), '')"


_STRENGTH = "(support + 1) / (support + neg_covered + 3) * ln(1 + support)"


@query(
    "k9_describe_examples",
    f"WITH {ORDERS_SQL}, {rules_sql(R)}"
    + f", {fired_sql('ord', ['o_orderkey', 'y'], R)} SELECT o.o_orderkey, {_top_sql(_STRENGTH, '=')} AS top_true_rule_raw, "
    f"{_top_sql(_STRENGTH, '<>')} AS top_wrong_rule_raw, {_top_sql('(1 - om)', '=')} AS top_true_rule_certainty, "
    f"{_top_sql('(1 - om)', '<>')} AS top_wrong_rule_certainty "
    "FROM (SELECT o_orderkey, y FROM ord) o LEFT JOIN (SELECT o_orderkey, fired.rule_id, label, caption, support, neg_covered, om FROM fired JOIN rules USING (rule_id)) f "
    "ON o.o_orderkey = f.o_orderkey GROUP BY o.o_orderkey",
)
def k9_describe_examples(spark, sf_dir):
    return H.describe_examples(orders(spark, sf_dir), R, KEY)


def _yager_ctes() -> str:
    ctes = ["y0 AS (SELECT o_orderkey, y, status, o_totalprice, c_acctbal, prio, nation, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 1.0::DOUBLE AS ao FROM ord)"]
    for i, r in enumerate(R):
        b = [f"{v!r}::DOUBLE" for v in r.mass]
        new = {f"a{c}": f"a{c} * {b[c]} + a{c} * {b[3]} + ao * {b[c]}" for c in range(3)}
        conflict = " + ".join(f"a{c} * {b[d]}" for c in range(3) for d in range(3) if c != d)
        new["ao"] = f"ao * {b[3]} + {conflict}"
        swaps = ", ".join(f"CASE WHEN {rule_sql(r)} THEN {e} ELSE {c} END AS {c}" for c, e in new.items())
        ctes.append(f"y{i + 1} AS (SELECT * REPLACE ({swaps}) FROM y{i})")
    return ", ".join(ctes)


_RIGHT_BIN = " + ".join(f"(conf > {i / 15!r}::DOUBLE)::INT" for i in range(1, 15))
_BEST3 = "CASE WHEN {0}0 >= {0}1 AND {0}0 >= {0}2 THEN 0 WHEN {0}1 >= {0}2 THEN 1 ELSE 2 END"
SUBSETS = f"""WITH {ORDERS_SQL}, {fused_sql('ord', ['o_orderkey', 'y', 'status'], R)}, {votes_sql('ord', ['o_orderkey', 'y', 'status'], R)}, {_yager_ctes()},
ms AS (SELECT 'dempster' AS method, y, status, pred, p0, p1, p2, om FROM fused
  UNION ALL SELECT 'vote', y, status, {_BEST3.format('v')}, v0 / s, v1 / s, v2 / s, NULL FROM
     (SELECT y, status, CASE WHEN t = 0 THEN 1 ELSE v0 END AS v0, CASE WHEN t = 0 THEN 1 ELSE v1 END AS v1, CASE WHEN t = 0 THEN 1 ELSE v2 END AS v2,
             CASE WHEN t = 0 THEN 3 ELSE t END AS s FROM (SELECT *, v0 + v1 + v2 AS t FROM voted))
  UNION ALL SELECT 'yager', y, status, {_BEST3.format('a')}, a0 + ao / 3, a1 + ao / 3, a2 + ao / 3, ao FROM y{len(R)}),
al AS (SELECT 'full' AS subset, * FROM ms UNION ALL SELECT CASE WHEN status = 1 THEN 'outlier' ELSE 'inlier' END, * FROM ms),
x AS (SELECT subset, method, y, pred, om, greatest(p0, p1, p2, 1e-12) AS conf, greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12) AS py,
       greatest(p0, 1e-12) + greatest(p1, 1e-12) + greatest(p2, 1e-12) AS t FROM al),
z AS (SELECT subset, method, y, pred, om, conf / t AS conf, py / t AS py FROM x),
e AS (SELECT subset, method, sum(abs(h - c)) / sum(n) AS ece FROM (SELECT subset, method, {_RIGHT_BIN} AS b, count(*) AS n, sum((pred = y)::INT) AS h, sum(conf) AS c FROM z GROUP BY ALL) GROUP BY ALL),
m AS (SELECT subset, method, count(*) AS n_rows, {_quality_sql('q', 'pred').replace('true_label', 'y').replace('q_acc', 'acc').replace('q_macro_f1', 'macro_f1').replace('q_precision', 'precision').replace('q_recall', 'recall')},
      avg(-ln(py)) AS nll, avg(om) AS avg_omega FROM z GROUP BY ALL)"""


@query(
    "k10_evaluate_subsets",
    rounded_sql(f"{SUBSETS} SELECT m.*, ece FROM m JOIN e USING (subset, method)", "acc macro_f1 precision recall nll avg_omega ece", 5),
)
def k10_evaluate_subsets(spark, sf_dir):
    part = F.when(F.col("status") == 1, "outlier").otherwise("inlier")
    return rounded(H.evaluate_subsets(orders(spark, sf_dir), R, part), 5)
