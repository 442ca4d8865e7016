"""Analytics over benchmark runs: one row per (dataset, inducer, seed, split_seed, system)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = ("acc", "macro_f1", "precision", "recall", "nll", "ece", "unc_mean", "unc_comb")
LOWER_IS_BETTER = ("nll", "ece", "unc_mean", "unc_comb")

# Aliases of system names, fixed values.
SYSTEM_ALIASES = {
    "dempster": "dsgd_dempster", "dsgd_dempster": "dsgd_dempster",
    "vote": "weighted_vote", "weighted_vote": "weighted_vote",
    "native_ordered_rule": "native_ordered_rule", "ordered_rule": "native_ordered_rule", "ordered": "native_ordered_rule",
    "first_hit": "first_hit_laplace", "first_hit_laplace": "first_hit_laplace",
}
# The method pairs compared for significance, fixed values.
COMPARISONS = (
    ("FOIL:dsgd_dempster", "FOIL:weighted_vote"),
    ("FOIL:dsgd_dempster", "FOIL:first_hit_laplace"),
    ("FOIL:dsgd_dempster", "FOIL:native_ordered_rule"),
    ("RIPPER:dsgd_dempster", "RIPPER:weighted_vote"),
    ("RIPPER:dsgd_dempster", "RIPPER:first_hit_laplace"),
    ("RIPPER:dsgd_dempster", "RIPPER:native_ordered_rule"),
)
RUN_KEYS = ("dataset", "seed", "split_seed")


def canonical_method(inducer: Column, system: Column) -> Column:
    """`RF`, or INDUCER:system with the system's canonical name."""
    inducer = F.upper(F.trim(F.coalesce(inducer, F.lit(""))))
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(system, F.lit("")))), "-", "_")
    names = F.create_map(*[F.lit(x) for pair in SYSTEM_ALIASES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, plain), plain)
    return F.when((plain == "rf") | (inducer == "RF"), "RF").when(inducer == "", name).otherwise(F.concat_ws(":", inducer, name))


def with_method(runs: DataFrame) -> DataFrame:
    """runs plus `method`; also reads the older column names (Dataset, Algo, Method, F1, Omega ...)."""
    lowered = runs.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in runs.columns])
    if "inducer" not in lowered.columns and "algo" in lowered.columns:
        lowered = lowered.withColumnRenamed("algo", "inducer").withColumnRenamed("method", "system")
    for old, new in (("f1", "macro_f1"), ("std_f1", "std_macro_f1"), ("omega", "unc_comb")):
        if old in lowered.columns and new not in lowered.columns:
            lowered = lowered.withColumnRenamed(old, new)
    present = [c for c in lowered.columns if c in METRICS or c in [f"std_{m}" for m in METRICS]]
    numbers = {c: F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None)) for c in present}
    return lowered.withColumns({**numbers, "method": canonical_method(F.col("inducer"), F.col("system"))})


def aggregate_runs(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per dataset and method: mean, sample deviation, min and max of every metric, runs and seeds."""
    present = [m for m in (*metrics, "fusion_depth") if m in runs.columns]
    value = lambda m: F.nanvl(F.col(m), F.lit(None))
    return runs.groupBy("dataset", "method").agg(
        *[
            f(value(m)).alias(name)
            for m in present
            for f, name in ((F.avg, m), (F.stddev_samp, f"std_{m}"), (F.min, f"min_{m}"), (F.max, f"max_{m}"))
        ],
        F.count("*").alias("n_runs"), F.count_distinct("seed").alias("n_seeds"),
    )


def metric_pivot(agg: DataFrame, metric: str, methods: Sequence[str]) -> DataFrame:
    return agg.groupBy("dataset").pivot("method", list(methods)).agg(F.first(metric))


def metric_cells(agg: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(dataset, method, metric, value, score): long form; score is the value with higher always better."""
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (-F.col(m) if m in LOWER_IS_BETTER else F.col(m)).alias("score"))
            for m in metrics if m in agg.columns
        ]
    )
    return agg.select("dataset", "method", F.explode(cells).alias("c")).select("dataset", "method", "c.*").where("value IS NOT NULL")


def mean_rank(agg: DataFrame, metrics: Sequence[str] = METRICS, *, tie: float = 1e-12) -> DataFrame:
    """Mean and population deviation over datasets of each method's rank, ties sharing their average rank.

    Scores tie with the best of their run: a run ends at the first score more than `tie` below its first one. A dataset
    and metric has a score per method, few enough to be walked inside one row.
    """
    cells = metric_cells(agg, metrics)
    scores = cells.groupBy("dataset", "metric").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "method"))).alias("xs"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<double>").alias("firsts"))

    def walk(acc: Column, x: Column) -> Column:
        first = F.when(acc["first"].isNull() | (x["s"] - acc["first"] > tie), x["s"]).otherwise(acc["first"])
        return F.struct(first.alias("first"), F.array_append(acc["firsts"], first).alias("firsts"))

    firsts = F.aggregate("xs", start, walk, lambda acc: acc["firsts"])
    runs = scores.withColumn("run", firsts).select("dataset", "metric", F.explode(F.arrays_zip("xs", "run")).alias("c"))
    runs = runs.select("dataset", "metric", F.col("c.xs.method").alias("method"), F.col("c.run").alias("run"))
    order = Window.partitionBy("dataset", "metric").orderBy("run")
    same = Window.partitionBy("dataset", "metric", "run")
    ranked = runs.withColumn("rank", F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0)
    return ranked.groupBy("metric", "method").agg(F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"))


def best_vs_baseline(agg: DataFrame, metrics: Sequence[str] = METRICS, *, baseline: str = "RF") -> DataFrame:
    """Per dataset and metric the best rule method, its value, and its signed advantage over the baseline."""
    cells = metric_cells(agg, metrics)
    base = cells.where(F.col("method") == baseline).select("dataset", "metric", F.col("value").alias("rf_value"), F.col("score").alias("rf_score"))
    best = cells.where(F.col("method") != baseline).groupBy("dataset", "metric").agg(
        F.min_by(F.struct("method", "value", "score"), F.struct(-F.col("score"), F.col("method"))).alias("b")
    )
    return best.join(base, ["dataset", "metric"]).select(
        "dataset", "metric", "rf_value", F.col("b.method").alias("best_rule_method"), F.col("b.value").alias("best_rule_value"),
        (F.col("b.score") - F.col("rf_score")).alias("delta_vs_rf"), (F.col("b.score") > F.col("rf_score")).alias("beats_rf"),
    )


def report_summary(agg: DataFrame, metrics: Sequence[str] = ("acc", "macro_f1", "nll", "ece", "unc_mean", "unc_comb")) -> DataFrame:
    """Per method and metric: mean over datasets, mean deviation, whether it is the best (within 1e-12), and support."""
    present = [m for m in metrics if m in agg.columns]
    std = lambda m: F.col(f"std_{m}") if f"std_{m}" in agg.columns else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), std(m).alias("s")) for m in present])
    runs = F.coalesce(F.col("n_runs"), F.lit(1)) if "n_runs" in agg.columns else F.lit(1)
    seeds = F.coalesce(F.col("n_seeds"), F.lit(0)) if "n_seeds" in agg.columns else F.lit(0)
    rows = agg.select("method", runs.alias("n_runs"), seeds.alias("n_seeds"), F.explode(cells).alias("c")).select("*", "c.*")
    means = rows.groupBy("method", "metric").agg(
        F.avg("v").alias("mean"), F.avg("s").alias("mean_std"), F.count("*").alias("dataset_rows"),
        F.sum("n_runs").alias("n_runs"), F.max("n_seeds").alias("max_n_seeds"),
    )
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    top = F.max(F.col("mean") * sign).over(Window.partitionBy("metric"))
    return means.withColumn("is_best", F.col("mean").isNotNull() & (F.abs(F.col("mean") * sign - top) <= 1e-12))


def paired_deltas(runs: DataFrame, pairs: Sequence[tuple[str, str]] = COMPARISONS, metrics: Sequence[str] = ("macro_f1", "acc", "nll", "ece")) -> DataFrame:
    """(left, right, metric, keys..., left_value, right_value, delta) where both methods ran.

    Pairs share dataset, seed, split seed and, where recorded, pool shaping. The runs are averaged once
    per (keys, method); every comparison is then read off the same grouped row.
    """
    keys = [*RUN_KEYS, *(["pool_shaping"] if "pool_shaping" in runs.columns else [])]
    methods = sorted({m for pair in pairs for m in pair})
    long = runs.where(F.col("method").isin(methods)).select(
        *keys, "method",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m), F.lit(None)).alias("v")) for m in metrics])).alias("c"),
    ).select(*keys, "method", "c.*")
    wide = long.groupBy(*keys, "metric").pivot("method", methods).agg(F.avg("v"))
    sides = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}`").alias("left_value"), F.col(f"`{b}`").alias("right_value"))
            for a, b in pairs
        ]
    )
    rows = wide.select(*keys, "metric", F.explode(sides).alias("s")).select(*keys, "metric", "s.*")
    return rows.where("left_value IS NOT NULL AND right_value IS NOT NULL").withColumn("delta", F.col("left_value") - F.col("right_value"))


def signed_ranks(deltas: DataFrame, by: Sequence[str] = ("metric", "left", "right")) -> DataFrame:
    """Wilcoxon ranks of |delta| without zeros, ties sharing their average rank; `signed` is delta with higher better."""
    signed = F.when(F.col("metric").isin("macro_f1", "acc"), F.col("delta")).otherwise(-F.col("delta"))
    rows = deltas.withColumn("signed", signed).where("delta <> 0").withColumn("size", F.abs("delta"))
    order = Window.partitionBy(*by).orderBy("size")
    same = F.count("*").over(Window.partitionBy(*by, "size"))
    return rows.withColumn("rank", F.rank().over(order) + (same - 1) / 2.0).withColumn("ties", same)


def significance(deltas: DataFrame, by: Sequence[str] = ("metric", "left", "right")) -> DataFrame:
    """n, mean, median, wins, losses, W+ and the one-sided Wilcoxon p-value where n >= 5 and some |delta| > 1e-12.

    Small samples without ties or zeros get the exact tail, others the normal approximation with tie correction.
    """
    stats = deltas.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.5).alias("median_delta"),
        F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.max(F.abs("delta")).alias("top"),
    )
    ranks = signed_ranks(deltas, by).groupBy(*by).agg(
        F.sum(F.when(F.col("signed") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n_used"),
        F.sum(F.col("ties") * F.col("ties") - 1.0).alias("tie_sum"),
    )
    tested = (F.col("n") >= 5) & (F.col("top") > 1e-12)
    rows = stats.join(ranks, list(by), "left").withColumn("test", F.when(tested, "wilcoxon").otherwise("none"))
    n = F.col("n_used").cast("double")
    mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_sum") / 48.0
    z = F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(F.when(var > 0, var).otherwise(1.0)))
    exact = (F.col("n_used") <= 50) & (F.col("n_used") == F.col("n")) & (F.col("tie_sum") == 0)
    rows = rows.withColumn("z", z).withColumn("exact", exact)
    return rows.withColumn("p_value", F.when(tested, wilcoxon_tail("n_used", "w_plus", "z", "exact"))).drop("top", "tie_sum")


def wilcoxon_tail(*columns: str) -> Column:
    """P(W+ >= w) on aggregated rows, one per comparison."""
    @F.pandas_udf("double")
    def tail(n: pd.Series, w: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([_tail(*x) for x in zip(n, w, z, exact)], dtype="float64")

    return tail(*columns)


def _tail(n, w, z, exact) -> float | None:
    if n is None or w is None or math.isnan(n) or math.isnan(w):
        return None
    if exact:
        ways = [1]  # ways[s]: subsets of 1..n with sum s
        for rank in range(1, int(n) + 1):
            longer = ways + [0] * rank
            for s, k in enumerate(ways):
                longer[s + rank] += k
            ways = longer
        return sum(ways[math.ceil(w - 1e-9):]) / 2 ** int(n)
    if z is None or math.isnan(z):
        return None
    return 0.5 * math.erfc(z / math.sqrt(2))


def cost_summary(runs: DataFrame) -> DataFrame:
    """Per method mean, sample deviation, min and max of training time, rules and literals."""
    columns = ("train_wall_sec", "n_rules", "avg_literals")
    return runs.groupBy("method").agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}_{name}")
            for c in columns
            for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))
        ]
    )


def slowest_runs(runs: DataFrame, k: int = 20) -> DataFrame:
    keys = ["dataset", "method", "seed", "split_seed"]
    return runs.select(*keys, "train_wall_sec", "n_rules", "avg_literals").orderBy(F.desc("train_wall_sec"), *keys).limit(k)


ABLATION_METHODS = ("FOIL:dsgd_dempster", "RIPPER:dsgd_dempster")


def _shaping_rows(runs: DataFrame, methods: Sequence[str]) -> DataFrame:
    return runs.where(F.col("method").isin(*methods) & F.col("pool_shaping").isNotNull())


def ablation_coverage(runs: DataFrame, methods: Sequence[str] = ABLATION_METHODS) -> DataFrame:
    """Per method: rows with shaping off and on, and how many (dataset, seed, split) have both."""
    rows = _shaping_rows(runs, methods)
    combos = rows.groupBy("method", *RUN_KEYS).agg(
        F.count_if(~F.col("pool_shaping")).alias("off"), F.count_if("pool_shaping").alias("on")
    )
    return combos.groupBy("method").agg(
        F.sum("off").alias("shaping_false_rows"), F.sum("on").alias("shaping_true_rows"),
        F.count_if((F.col("off") > 0) & (F.col("on") > 0)).alias("paired_combos"),
    )


def ablation(runs: DataFrame, metrics: Sequence[str] = ("macro_f1", "acc", "nll", "ece"), methods: Sequence[str] = ABLATION_METHODS) -> DataFrame:
    """Per metric and method the paired on - off deltas and wins in the metric's direction; empty when nothing pairs."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m), F.lit(None)).alias("v")) for m in metrics])
    long = _shaping_rows(runs, methods).select("method", *RUN_KEYS, "pool_shaping", F.explode(cells).alias("c")).select("*", "c.*")
    sides = long.groupBy("method", *RUN_KEYS, "metric").pivot("pool_shaping", [True, False]).agg(F.avg("v"))
    deltas = sides.withColumn("delta", F.col("true") - F.col("false")).where("delta IS NOT NULL")
    gain = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("delta")).otherwise(F.col("delta"))
    return deltas.groupBy("metric", "method").agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_on_minus_off"), F.percentile("delta", 0.5).alias("median_on_minus_off"),
        F.count_if(gain > 0).alias("shaping_on_wins"), F.count_if(gain < 0).alias("shaping_off_wins"),
    )
