"""Run-analytics queries (L) over a runs table aggregated from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, rounded, rounded_sql, table
from rulespark.operators import experiments as E

registry = Registry()
query = registry.query

# One run per (dataset, inducer, system, seed, shaping); figures are means over that run's line items.
_COLUMNS = """l_returnflag AS dataset,
 CASE WHEN l_partkey % 9 = 8 THEN 'rf' WHEN l_partkey % 2 = 0 THEN 'foil' ELSE 'RIPPER' END AS inducer,
 CASE WHEN l_partkey % 9 = 8 THEN 'rf' WHEN l_suppkey % 4 = 0 THEN 'dempster' WHEN l_suppkey % 4 = 1 THEN 'Vote'
      WHEN l_suppkey % 4 = 2 THEN 'first-hit' ELSE 'ordered' END AS system,
 l_linenumber AS seed, l_linenumber + 40 AS split_seed, l_orderkey % 3 = 0 AS pool_shaping"""
_METRICS = """avg(l_discount) * 10 AS acc, avg(l_tax) * 12 AS macro_f1, avg(l_tax + l_discount) AS precision, avg(l_quantity) / 50 AS recall,
 avg(l_extendedprice) / 50000 AS nll, avg(abs(l_discount - l_tax)) AS ece, avg(l_tax) AS unc_mean, avg(l_discount * l_quantity) AS unc_comb,
 avg(l_linenumber * l_quantity) AS fusion_depth, sum(l_quantity) AS train_wall_sec, count(*) AS n_rules, avg(l_quantity) AS avg_literals"""
_GROUP = "dataset, inducer, system, seed, split_seed, pool_shaping"
RAW = f"raw AS (SELECT {_GROUP}, {_METRICS} FROM (SELECT *, {_COLUMNS} FROM lineitem) GROUP BY {_GROUP})"
RUNS = f"""{RAW}, runs AS (SELECT *, CASE WHEN inducer = 'rf' THEN 'RF' ELSE upper(inducer) || ':' ||
   CASE system WHEN 'dempster' THEN 'dsgd_dempster' WHEN 'Vote' THEN 'weighted_vote' WHEN 'first-hit' THEN 'first_hit_laplace' ELSE 'native_ordered_rule' END END AS method FROM raw)"""
_AGG_COLS = ", ".join(
    f"{f}({m}) AS {p}{m}" for m in (*E.METRICS, "fusion_depth") for f, p in (("avg", ""), ("stddev_samp", "std_"), ("min", "min_"), ("max", "max_"))
)
AGG = f"{RUNS}, agg AS (SELECT dataset, method, {_AGG_COLS}, count(*) AS n_runs, count(DISTINCT seed) AS n_seeds FROM runs GROUP BY dataset, method)"
CELLS = f"{AGG}, cells AS (" + " UNION ALL ".join(
    f"SELECT dataset, method, '{m}' AS metric, {m} AS value, {'-' if m in E.LOWER_IS_BETTER else ''}{m} AS score FROM agg" for m in E.METRICS
) + ")"
METHODS = ["RF"] + [f"{i}:{s}" for i in ("FOIL", "RIPPER") for s in ("dsgd_dempster", "weighted_vote", "first_hit_laplace", "native_ordered_rule")]


def raw_runs(spark, sf_dir):
    cols = table(spark, sf_dir, "lineitem").selectExpr("*", *[c.strip() for c in _split(_COLUMNS)])
    return cols.groupBy(*_GROUP.split(", ")).agg(*[F.expr(m.strip()) for m in _split(_METRICS)])


def _split(text: str) -> list[str]:
    """Split an SQL select list at its top-level commas."""
    out, depth, word = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word]


def runs(spark, sf_dir):
    return E.with_method(raw_runs(spark, sf_dir))


def aggregated(spark, sf_dir):
    return E.aggregate_runs(runs(spark, sf_dir))


@query("l1_canonical_method", f"WITH {RUNS} SELECT inducer, system, method, count(*) AS n FROM runs GROUP BY ALL")
def l1_canonical_method(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("inducer", "system", "method").agg(F.count("*").alias("n"))


@query(
    "l2_aggregate_runs",
    rounded_sql(
        f"WITH {AGG} SELECT * FROM agg",
        " ".join(f"{p}{m}" for m in (*E.METRICS, "fusion_depth") for p in ("", "std_", "min_", "max_")),
    ),
)
def l2_aggregate_runs(spark, sf_dir):
    return rounded(aggregated(spark, sf_dir))


@query(
    "l3_metric_pivot",
    rounded_sql(
        f"WITH {AGG} SELECT dataset, " + ", ".join(f"max(acc) FILTER (WHERE method = '{m}') AS \"{m}\"" for m in METHODS) + " FROM agg GROUP BY dataset",
        " ".join(f'"{m}"' for m in METHODS),
    ),
)
def l3_metric_pivot(spark, sf_dir):
    return rounded_names(E.metric_pivot(aggregated(spark, sf_dir), "acc", METHODS))


def rounded_names(df):
    return df.select("dataset", *[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) for c in df.columns if c != "dataset"])


@query(
    "l4_mean_rank",
    rounded_sql(
        f"""WITH {CELLS}, r AS (SELECT metric, method, rank() OVER (PARTITION BY dataset, metric ORDER BY score DESC)
              + (count(*) OVER (PARTITION BY dataset, metric, score) - 1) / 2.0 AS rk FROM cells)
        SELECT metric, method, avg(rk) AS mean_rank, stddev_pop(rk) AS std_rank FROM r GROUP BY metric, method""",
        "mean_rank std_rank",
    ),
)
def l4_mean_rank(spark, sf_dir):
    return rounded(E.mean_rank(aggregated(spark, sf_dir)))


@query(
    "l5_best_vs_baseline",
    rounded_sql(
        f"""WITH {CELLS}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY score DESC, method) AS r FROM cells WHERE method <> 'RF')
        SELECT dataset, metric, f.value AS rf_value, b.method AS best_rule_method, b.value AS best_rule_value, b.score - f.score AS delta_vs_rf,
               b.score > f.score AS beats_rf FROM b JOIN cells f USING (dataset, metric) WHERE r = 1 AND f.method = 'RF'""",
        "rf_value best_rule_value delta_vs_rf",
    ),
)
def l5_best_vs_baseline(spark, sf_dir):
    return rounded(E.best_vs_baseline(aggregated(spark, sf_dir)))


_BRIEF = ("acc", "macro_f1", "nll", "ece", "unc_mean", "unc_comb")


@query(
    "l6_report_summary",
    rounded_sql(
        f"WITH {AGG}, c AS ("
        + " UNION ALL ".join(
            f"SELECT method, '{m}' AS metric, {m} AS v, std_{m} AS s, n_runs, n_seeds, {'-1' if m in E.LOWER_IS_BETTER else '1'} AS sg FROM agg" for m in _BRIEF
        )
        + "), m AS (SELECT method, metric, avg(v) AS mean, avg(s) AS mean_std, count(*) AS dataset_rows, sum(n_runs)::BIGINT AS n_runs, max(n_seeds) AS max_n_seeds, max(sg) AS sg "
        "FROM c GROUP BY method, metric) SELECT * EXCLUDE (sg), abs(mean * sg - max(mean * sg) OVER (PARTITION BY metric)) <= 1e-12 AS is_best FROM m",
        "mean mean_std",
    ),
)
def l6_report_summary(spark, sf_dir):
    return rounded(E.report_summary(aggregated(spark, sf_dir)))


PAIRED = f"""{RUNS}, avgs AS (SELECT dataset, seed, split_seed, pool_shaping, method, metric, avg(v) AS v FROM
   ({' UNION ALL '.join(f"SELECT dataset, seed, split_seed, pool_shaping, method, '{m}' AS metric, {m} AS v FROM runs" for m in ('macro_f1', 'acc', 'nll', 'ece'))}) GROUP BY ALL),
pairs(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in E.COMPARISONS)}),
pd AS (SELECT x.dataset, x.seed, x.split_seed, x.pool_shaping, x.metric, a AS "left", b AS "right", x.v AS left_value, y.v AS right_value, x.v - y.v AS delta
       FROM pairs JOIN avgs x ON x.method = a JOIN avgs y ON y.method = b AND y.dataset = x.dataset AND y.seed = x.seed AND y.split_seed = x.split_seed
            AND y.pool_shaping = x.pool_shaping AND y.metric = x.metric)"""


@query("l7_paired_deltas", rounded_sql(f"WITH {PAIRED} SELECT * FROM pd", "left_value right_value delta"))
def l7_paired_deltas(spark, sf_dir):
    return rounded(E.paired_deltas(runs(spark, sf_dir)))


@query(
    "l8_significance",
    rounded_sql(
        f"""WITH {PAIRED}, s AS (SELECT metric, "left", "right", count(*) AS n, avg(delta) AS mean_delta, median(delta) AS median_delta,
              count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta < 0) AS losses FROM pd GROUP BY ALL),
        r AS (SELECT *, rank() OVER (PARTITION BY metric, "left", "right" ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY metric, "left", "right", abs(delta)) - 1) / 2.0 AS rk,
              CASE WHEN metric IN ('acc', 'macro_f1') THEN delta ELSE -delta END AS sd FROM pd WHERE delta <> 0),
        w AS (SELECT metric, "left", "right", sum(CASE WHEN sd > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus, count(*) AS n_used FROM r GROUP BY ALL)
        SELECT s.*, w_plus, n_used, 'wilcoxon' AS test FROM s JOIN w USING (metric, "left", "right")""",
        "mean_delta median_delta w_plus",
    ),
)
def l8_significance(spark, sf_dir):
    return rounded(E.significance(E.paired_deltas(runs(spark, sf_dir))).drop("z", "exact", "p_value"))


# erf(x) = 2/sqrt(pi) exp(-x^2) sum of 2^k x^(2k+1) / (1*3*...*(2k+1)): positive terms only, each from the one before.
_ERF = (
    "(2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(150), lambda k: "
    "exp(k * ln(2) + (2 * k + 1) * ln(x) - list_sum(list_transform(range(k + 1), lambda j: ln(2 * j + 1)))))))"
)


@query(
    "l8_significance_p_values",
    rounded_sql(
        f"""WITH RECURSIVE {PAIRED}, s AS (SELECT metric, "left", "right", count(*) AS n, max(abs(delta)) AS top FROM pd GROUP BY ALL),
        r AS (SELECT *, count(*) OVER (PARTITION BY metric, "left", "right", abs(delta)) AS ties,
              rank() OVER (PARTITION BY metric, "left", "right" ORDER BY abs(delta)) + (ties - 1) / 2.0 AS rk,
              CASE WHEN metric IN ('acc', 'macro_f1') THEN delta ELSE -delta END AS sd FROM pd WHERE delta <> 0),
        w AS (SELECT metric, "left", "right", sum(CASE WHEN sd > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus, count(*) AS n_used,
              sum(ties * ties - 1)::DOUBLE AS tie_sum FROM r GROUP BY ALL),
        ways AS (SELECT 0 AS k, list_transform(range(1276), lambda s: (s = 0)::BIGINT) AS c UNION ALL
                 SELECT k + 1, list_transform(range(1, 1277), lambda s: c[s] + CASE WHEN s > k + 1 THEN c[s - k - 1] ELSE 0 END) FROM ways WHERE k < 50),
        z AS (SELECT *, n_used * (n_used + 1) * (2 * n_used + 1) / 24.0 - tie_sum / 48.0 AS var, n_used <= 50 AND n_used = n AND tie_sum = 0 AS exact,
              CASE WHEN var > 0 THEN (w_plus - n_used * (n_used + 1) / 4.0) / sqrt(var) END AS z, abs(z) / sqrt(2) AS x
              FROM s LEFT JOIN w USING (metric, "left", "right")),
        tail AS (SELECT *, 0.5 * (1 - CASE WHEN z = 0 THEN 0 ELSE sign(z) * {_ERF} END) AS normal FROM z)
        SELECT metric, "left", "right", n_used, w_plus, CASE WHEN n < 5 OR top <= 1e-12 THEN NULL
               WHEN exact THEN list_sum(c[ceil(w_plus - 1e-9)::BIGINT + 1:])::DOUBLE / pow(2, k) ELSE normal END AS p_value
        FROM tail LEFT JOIN ways ON k = n_used""",
        "w_plus p_value", 9,
    ),
)
def l8_significance_p_values(spark, sf_dir):
    """The one-sided tail: exact over subsets of the ranks where nothing ties and nothing is zero, else normal with tie correction."""
    found = E.significance(E.paired_deltas(runs(spark, sf_dir)))
    return rounded(found.select("metric", "left", "right", "n_used", "w_plus", "p_value"), 9)


@query(
    "l9_cost_summary",
    rounded_sql(
        f"WITH {RUNS} SELECT method, "
        + ", ".join(
            f"{f}({c}::DOUBLE) AS {c}_{n}" for c in ("train_wall_sec", "n_rules", "avg_literals")
            for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
        )
        + " FROM runs GROUP BY method",
        " ".join(f"{c}_{n}" for c in ("train_wall_sec", "n_rules", "avg_literals") for n in ("mean", "std", "min", "max")),
    ),
)
def l9_cost_summary(spark, sf_dir):
    return rounded(E.cost_summary(runs(spark, sf_dir)))


@query(
    "l9_slowest_runs",
    rounded_sql(
        f"WITH {RUNS} SELECT dataset, method, seed, split_seed, train_wall_sec, n_rules, avg_literals FROM runs "
        "ORDER BY train_wall_sec DESC, dataset, method, seed, split_seed LIMIT 20",
        "train_wall_sec avg_literals",
    ),
)
def l9_slowest_runs(spark, sf_dir):
    return rounded(E.slowest_runs(runs(spark, sf_dir)))


@query(
    "l10_ablation_coverage",
    f"""WITH {RUNS}, c AS (SELECT method, dataset, seed, split_seed, count(*) FILTER (WHERE NOT pool_shaping) AS off, count(*) FILTER (WHERE pool_shaping) AS on_
        FROM runs WHERE method LIKE '%:dsgd_dempster' GROUP BY ALL)
        SELECT method, sum(off)::BIGINT AS shaping_false_rows, sum(on_)::BIGINT AS shaping_true_rows, count(*) FILTER (WHERE off > 0 AND on_ > 0) AS paired_combos FROM c GROUP BY method""",
)
def l10_ablation_coverage(spark, sf_dir):
    return E.ablation_coverage(runs(spark, sf_dir))


@query(
    "l10_ablation",
    rounded_sql(
        f"""WITH {RUNS}, lg AS ({' UNION ALL '.join(f"SELECT method, dataset, seed, split_seed, pool_shaping, '{m}' AS metric, {m} AS v FROM runs WHERE method LIKE '%:dsgd_dempster'" for m in ('macro_f1', 'acc', 'nll', 'ece'))}),
        d AS (SELECT method, metric, avg(v) FILTER (WHERE pool_shaping) - avg(v) FILTER (WHERE NOT pool_shaping) AS delta FROM lg GROUP BY method, dataset, seed, split_seed, metric)
        SELECT metric, method, count(*) AS n, avg(delta) AS mean_on_minus_off, median(delta) AS median_on_minus_off,
               count(*) FILTER (WHERE CASE WHEN metric IN ('nll', 'ece') THEN -delta ELSE delta END > 0) AS shaping_on_wins,
               count(*) FILTER (WHERE CASE WHEN metric IN ('nll', 'ece') THEN -delta ELSE delta END < 0) AS shaping_off_wins
        FROM d WHERE delta IS NOT NULL GROUP BY metric, method""",
        "mean_on_minus_off median_on_minus_off",
    ),
)
def l10_ablation(spark, sf_dir):
    return rounded(E.ablation(runs(spark, sf_dir)))
