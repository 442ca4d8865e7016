"""Mining of rows on which the rules disagree: flags, buckets, summaries and examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.functions import mass as M
from rulespark.functions.arrays import unnest
from rulespark.operators import metrics
from rulespark.operators.activate import with_fired
from rulespark.operators.explain import vote_strength
from rulespark.operators.fuse import dempster_vec, fuse_yager_from, label_table, vote_vec, with_evidence
from rulespark.operators.predict import first_hit_vec
from rulespark.rules import RuleSet

# Names of flags and methods. Fixed values.
FLAGS = ("disagreement", "high_depth", "low_weighted_margin", "minority_true_rule_support", "one_true_many_wrong")
METHOD_PREDICTIONS = {
    "weighted_vote": "pred_weighted_vote", "first_hit_laplace": "pred_first_hit_laplace",
    "dsgd_dempster": "pred_dsgd_dempster", "rf": "pred_rf",
}


def _true_and_wrong(array: str, k: int, y: Column) -> tuple[Column, Column]:
    values = M.unpack(F.col(array), k)
    true = F.get(F.col(array), y)
    wrong = F.greatest(*[F.when(y != c, v) for c, v in enumerate(values)]) if k > 2 else F.get(F.col(array), 1 - y)
    return true, F.coalesce(wrong, F.lit(0.0))


def class_support(df: DataFrame, rules: RuleSet, *, y: str = "y", keep: Sequence[str] | None = None) -> DataFrame:
    """Per row: fired rules, vote strength and class mass for the true class and the strongest wrong one, all row-local."""
    k = rules.n_classes
    extra = {
        "strength": label_table(rules, lambda r: vote_strength(r, k)),
        "support": [list(r.mass[:-1]) for r in rules],
    }
    rows = with_evidence(df, rules, extra=extra)
    label = F.col(y)
    true_n, wrong_n = _true_and_wrong("evidence.votes", k, label)
    true_s, wrong_s = _true_and_wrong("evidence.strength", k, label)
    true_m, wrong_m = _true_and_wrong("evidence.support", k, label)
    votes = M.unpack(F.col("evidence.votes"), k)
    return rows.select(
        *(keep if keep is not None else df.columns),
        "evidence",
        F.col("evidence.n_fired").alias("n_rules_fired"),
        M.total([(v > 0).cast("int") for v in votes]).alias("n_distinct_rule_labels"),
        M.total(votes).cast("int").alias("labeled_rule_count"),
        true_n.cast("int").alias("true_rule_count"), wrong_n.cast("int").alias("max_wrong_rule_count"),
        (M.total(votes) - true_n).cast("int").alias("wrong_rule_count_total"),
        true_s.alias("true_raw_vote_strength"), wrong_s.alias("max_wrong_raw_vote_strength"),
        true_m.alias("true_dsgd_support_sum"), wrong_m.alias("max_wrong_dsgd_support_sum"),
    )


def hard_case_samples(df: DataFrame, rules: RuleSet, key: Sequence[str], *, y: str = "y", tags: Sequence[str] = ("dataset", "algo")) -> DataFrame:
    """One row per scored row with the predictions, margins and supports of every method.

    df carries key, label, features, the tag columns and the baseline's `rf_pred` and `rf_proba`.
    """
    k = rules.n_classes
    keep = [*tags, *key, y, "rf_pred", "rf_proba"]
    rows = class_support(df, rules, y=y, keep=keep)
    none_fired = F.col("evidence.n_fired") == 0
    votes = M.unpack(F.col("evidence.votes"), k)
    voted = F.when(none_fired, F.lit(rules.default_label)).otherwise(M.argmax(votes))
    first = F.coalesce(F.col("evidence.first_label"), F.lit(rules.default_label))
    fused = dempster_vec(k)
    rows = rows.select(
        "*", first.cast("int").alias("pred_first_hit_laplace"), voted.cast("int").alias("pred_weighted_vote"),
        M.argmax(M.unpack(F.col("evidence.log_ratio"), k)).alias("pred_dsgd_dempster"),
        F.col("rf_pred").alias("pred_rf"), F.col(y).alias("true_label"),
        M.top2_margin(M.pignistic(vote_vec(k))).alias("weighted_vote_margin"),
        M.top2_margin(M.pignistic(fused)).alias("dsgd_margin"),
        M.top2_margin(M.unpack(F.col("rf_proba"), k)).alias("rf_margin"), fused[-1].alias("unc_comb_dempster"),
    )
    label = F.col("true_label")
    rows = rows.select(
        "*",
        *[(F.col(p) == label).alias(f"{n}_correct") for n, p in (("first_hit", "pred_first_hit_laplace"), ("weighted_vote", "pred_weighted_vote"), ("dsgd_dempster", "pred_dsgd_dempster"), ("rf", "pred_rf"))],
    )
    return rows.select(
        "*", (~F.col("first_hit_correct")).alias("first_hit_wrong"), (~F.col("weighted_vote_correct")).alias("weighted_vote_wrong"),
        (~F.col("weighted_vote_correct") & F.col("dsgd_dempster_correct")).alias("weighted_vote_fixed_by_dsgd"),
        (~F.col("first_hit_correct") & F.col("dsgd_dempster_correct")).alias("first_hit_fixed_by_dsgd"),
        (F.col("weighted_vote_correct") & ~F.col("dsgd_dempster_correct")).alias("weighted_vote_broken_by_dsgd"),
    ).drop("evidence", "rf_proba", "rf_pred", *([y] if y != "true_label" else []))


def depth_thresholds(samples: DataFrame, by: Sequence[str], *, quantile: float = 0.75, floor: int = 3) -> DataFrame:
    """Per group the fired-rule count from which a row counts as deep. Counts take at most R + 1 values,
    so the exact percentile aggregate stays small."""
    q = F.percentile("n_rules_fired", quantile)
    return samples.groupBy(*by).agg(F.greatest(F.lit(floor), F.ceil(q)).cast("int").alias("depth_threshold"))


def hard_flags(
    samples: DataFrame, by: Sequence[str] = ("dataset", "algo"), *, quantile: float = 0.75, depth_floor: int = 3,
    low_margin: float = 0.15, minority_gap: int = 1, wrong_many: int = 2,
) -> DataFrame:
    limits = depth_thresholds(samples, by, quantile=quantile, floor=depth_floor)
    rows = samples.join(F.broadcast(limits), list(by))  # one row per (dataset, algo)
    true, wrong = F.col("true_rule_count"), F.col("max_wrong_rule_count")
    return rows.select(
        "*",
        (F.col("n_distinct_rule_labels") >= 2).alias("disagreement"),
        (F.col("n_rules_fired") >= F.col("depth_threshold")).alias("high_depth"),
        (F.col("weighted_vote_margin") <= low_margin).alias("low_weighted_margin"),
        ((true >= 1) & (wrong - true >= minority_gap)).alias("minority_true_rule_support"),
        ((true == 1) & (wrong >= wrong_many)).alias("one_true_many_wrong"),
    )


def hard_case_base(flagged: DataFrame, *, min_flags: int = 1) -> DataFrame:
    """Rows with enough flags, their count and reasons."""
    count = M.total([F.col(f).cast("int") for f in FLAGS])
    reasons = F.concat_ws("|", *[F.when(F.col(f), F.lit(f)) for f in FLAGS])
    rows = flagged.select("*", count.alias("hard_case_flag_count"), reasons.alias("hard_case_reasons"))
    return rows.where((F.col("hard_case_flag_count") >= min_flags) | F.col("one_true_many_wrong"))


def _buckets() -> Column:
    wrong = F.col("weighted_vote_wrong")
    tests = {
        "all_test": F.lit(True), **{f: F.col(f) for f in FLAGS}, "weighted_vote_wrong": wrong,
        "weighted_vote_wrong_and_disagreement": wrong & F.col("disagreement"),
        "weighted_vote_fixed_by_dsgd": F.col("weighted_vote_fixed_by_dsgd"),
        "first_hit_fixed_by_dsgd": F.col("first_hit_fixed_by_dsgd"),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(b)) for b, t in tests.items()]))


# Columns of the bucket summary, the profile and the overview. Fixed values.
_MEANS = {
    "mean_rules_fired": "n_rules_fired", "mean_true_rule_count": "true_rule_count",
    "mean_max_wrong_rule_count": "max_wrong_rule_count", "mean_raw_margin_weighted": "weighted_vote_margin",
    "mean_dsgd_margin": "dsgd_margin", "mean_rf_margin": "rf_margin", "mean_unc_comb": "unc_comb_dempster",
    "mean_true_raw_vote_strength": "true_raw_vote_strength", "mean_max_wrong_raw_vote_strength": "max_wrong_raw_vote_strength",
    "mean_true_dsgd_support": "true_dsgd_support_sum", "mean_max_wrong_dsgd_support": "max_wrong_dsgd_support_sum",
}
_PREDS = {"weighted_vote": "pred_weighted_vote", "first_hit": "pred_first_hit_laplace", "dsgd_dempster": "pred_dsgd_dempster", "rf": "pred_rf"}


def bucket_summary(flagged: DataFrame, n_classes: int, by: Sequence[str] = ("dataset", "algo")) -> DataFrame:
    """Per group and (overlapping) bucket: size, quality of the four methods, deltas, fixes, breaks, means.

    Rows are reduced to (set of buckets, label, four predictions) cells before the shuffle; only those few cells are
    exploded into their buckets, and all figures come from one aggregate over them.
    """
    preds = list(_PREDS.values())
    kept = flagged.select(*by, "true_label", *preds, *[F.col(c).cast("double").alias(c) for c in _MEANS.values()], _buckets().alias("buckets"))
    sets = kept.groupBy(*by, "buckets", "true_label", *preds).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in _MEANS.values()]
    )
    cells = unnest(sets, [c for c in sets.columns if c != "buckets"], "buckets", "bucket")
    n = F.col("n")
    sums = [F.sum("n").alias("n_samples"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in _MEANS.values()]]
    for c in range(n_classes):
        sums.append(F.sum(F.when(F.col("true_label") == c, n).otherwise(0)).alias(f"t{c}"))
        for m, p in _PREDS.items():
            sums.append(F.sum(F.when(F.col(p) == c, n).otherwise(0)).alias(f"p_{m}{c}"))
            sums.append(F.sum(F.when((F.col(p) == c) & (F.col("true_label") == c), n).otherwise(0)).alias(f"tp_{m}{c}"))
    right = {m: F.col(p) == F.col("true_label") for m, p in _PREDS.items()}
    for m in ("weighted_vote", "first_hit"):
        sums.append(F.sum(F.when(~right[m] & right["dsgd_dempster"], n).otherwise(0)).alias(f"{m}_fix_count"))
        sums.append(F.sum(F.when(right[m] & ~right["dsgd_dempster"], n).otherwise(0)).alias(f"{m}_break_count"))
    got = cells.groupBy(*by, "bucket").agg(*sums)

    def scores(m: str) -> dict[str, Column]:
        tp = [F.col(f"tp_{m}{c}").cast("double") for c in range(n_classes)]
        t = [F.col(f"t{c}").cast("double") for c in range(n_classes)]
        p = [F.col(f"p_{m}{c}").cast("double") for c in range(n_classes)]
        ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b).otherwise(1.0)).otherwise(0.0)
        mean = lambda xs: M.total(xs) / n_classes
        return {
            "acc": M.total(tp) / F.col("n_samples"),
            "macro_f1": mean([ratio(2 * a, b + c) for a, b, c in zip(tp, t, p)]),
            "precision": mean([ratio(a, c) for a, c in zip(tp, p)]),
            "recall": mean([ratio(a, b) for a, b in zip(tp, t)]),
        }

    quality = got.select("*", *[v.alias(f"{m}_{k}") for m in _PREDS for k, v in scores(m).items()])
    delta = lambda a, b, k: (F.col(f"{a}_{k}") - F.col(f"{b}_{k}"))
    group = Window.partitionBy(*by)  # the ten bucket rows of a group
    out = quality.withColumn("all_rows", F.max(F.when(F.col("bucket") == "all_test", F.col("n_samples"))).over(group))
    return out.select(
        *by, "bucket", "n_samples", (F.col("n_samples") / F.col("all_rows")).alias("share_of_test"),
        *[f"weighted_vote_{k}" for k in ("acc", "macro_f1", "precision", "recall")], "first_hit_acc", "first_hit_macro_f1",
        *[f"dsgd_dempster_{k}" for k in ("acc", "macro_f1", "precision", "recall")], "rf_acc", "rf_macro_f1",
        *[delta("dsgd_dempster", "weighted_vote", k).alias(f"delta_{k}_vs_weighted") for k in ("acc", "macro_f1", "precision", "recall")],
        *[delta("rf", "weighted_vote", k).alias(f"delta_rf_{k}_vs_weighted") for k in ("acc", "macro_f1")],
        *[delta("dsgd_dempster", "rf", k).alias(f"delta_dsgd_{k}_vs_rf") for k in ("acc", "macro_f1")],
        "weighted_vote_fix_count", "weighted_vote_break_count", "first_hit_fix_count", "first_hit_break_count",
        *[(F.col(f"s_{c}") / F.col("n_samples")).alias(name) for name, c in _MEANS.items()],
    )


# Fixed values.
PROFILE_COLUMNS = (
    "n_samples", "share_of_test", "delta_acc_vs_weighted", "delta_macro_f1_vs_weighted", "delta_rf_acc_vs_weighted",
    "delta_rf_macro_f1_vs_weighted", "delta_dsgd_acc_vs_rf", "delta_dsgd_macro_f1_vs_rf", "weighted_vote_fix_count",
    "weighted_vote_break_count", "mean_rules_fired",
)


def bucket_profile(summary: DataFrame) -> DataFrame:
    """Mean of the bucket summary over datasets, per algorithm and bucket."""
    return summary.groupBy("algo", "bucket").agg(*[F.avg(c).alias(f"{c}_mean") for c in PROFILE_COLUMNS])


# Fixed values.
_OVERVIEW = {
    "mean_hard_flag_count": "hard_case_flag_count", **{f"share_{f}": f for f in FLAGS},
    "weighted_vote_acc": "weighted_vote_correct", "first_hit_acc": "first_hit_correct",
    "dsgd_dempster_acc": "dsgd_dempster_correct", "rf_acc": "rf_correct",
    "weighted_vote_fix_rate": "weighted_vote_fixed_by_dsgd", "weighted_vote_break_rate": "weighted_vote_broken_by_dsgd",
    "mean_rules_fired": "n_rules_fired", "mean_true_rule_count": "true_rule_count",
    "mean_max_wrong_rule_count": "max_wrong_rule_count", "mean_weighted_vote_margin": "weighted_vote_margin",
    "mean_dsgd_margin": "dsgd_margin", "mean_rf_margin": "rf_margin", "mean_unc_comb_dempster": "unc_comb_dempster",
}


def hard_base_overview(base: DataFrame, by: Sequence[str] = ("dataset", "algo")) -> DataFrame:
    return base.groupBy(*by).agg(
        F.count("*").alias("n_hard_cases"), *[F.avg(F.col(c).cast("double")).alias(name) for name, c in _OVERVIEW.items()]
    )


def hard_base_method_summary(base: DataFrame, n_classes: int, by: Sequence[str] = ("dataset", "algo")) -> DataFrame:
    """Quality of the four methods on the hard rows, averaged over the classes present as truth."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(p).alias("pred")) for m, p in METHOD_PREDICTIONS.items()])
    rows = base.select(*by, F.col("true_label").alias("y"), F.explode(pairs).alias("m")).select(*by, "y", "m.method", "m.pred")
    return metrics.summarise(rows, n_classes, [*by, "method"], labels="true")


def select_examples(flagged: DataFrame, key: Sequence[str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows the vote gets wrong and fusion right despite disagreement, the most contested first."""
    rows = flagged.where("weighted_vote_wrong AND dsgd_dempster_correct AND disagreement")
    order = [F.desc("max_wrong_rule_count"), F.desc("n_rules_fired"), F.asc("weighted_vote_margin"), F.desc("dsgd_margin"), *key]
    return rows.orderBy(*order).limit(limit)


def describe_examples(df: DataFrame, rules: RuleSet, key: Sequence[str], *, y: str = "y") -> DataFrame:
    """Per row the strongest fired rule for and against the true class, by vote strength and by certainty."""
    k = rules.n_classes
    labels = F.array(*[F.lit(r.label).cast("int") for r in rules])
    captions = F.array(*[F.lit(r.caption or "") for r in rules])
    scores = {
        "raw": F.array(*[F.lit(float(vote_strength(r, k))) for r in rules]),
        "certainty": F.array(*[F.lit(1.0 - float(r.mass[-1])) for r in rules]),
    }
    rows = with_fired(df, rules)

    def best(match: bool, score: str) -> Column:
        keep = F.filter("fired", lambda i: (F.get(labels, i) == F.col(y)) if match else (F.get(labels, i) != F.col(y)))
        ranked = F.array_sort(F.transform(keep, lambda i: F.struct((-F.get(scores[score], i)).alias("s"), i.alias("i"))))
        return F.coalesce(F.get(captions, F.get(ranked, F.lit(0))["i"]), F.lit(""))

    return rows.select(
        *key, *[best(match, s).alias(f"top_{'true' if match else 'wrong'}_rule_{s}") for s in scores for match in (True, False)]
    )


def evaluate_subsets(df: DataFrame, rules: RuleSet, subset: Column, *, y: str = "y") -> DataFrame:
    """Quality of vote, Dempster and Yager on each subset and on all rows, with the mean fused omega.

    The rules are matched once per row; the three fusions and two subset memberships fan out from there.
    """
    k = rules.n_classes
    rows = with_fired(df.select(subset.alias("part"), F.col(y).alias("y"), *rules.features), rules)
    rows = fuse_yager_from(with_evidence(rows, rules), rules)
    # The fused masses become columns first: a generator evaluates its expression without sharing subterms.
    ranking = {"vote": "evidence.votes", "dempster": "evidence.log_ratio", "yager": "yager"}
    rows = rows.select(
        "part", "y", *[M.argmax(M.unpack(F.col(c), k)).alias(f"pred_{m}") for m, c in ranking.items()],
        F.array(*vote_vec(k)).alias("vote"), F.array(*dempster_vec(k)).alias("dempster"), "yager",
    )
    cells = []
    for method in ranking:
        m = M.unpack(F.col(method), k + 1)
        omega = F.lit(None).cast("double") if method == "vote" else m[-1]
        cells.append(
            F.struct(F.lit(method).alias("method"), F.col(f"pred_{method}").alias("pred"), F.array(*M.pignistic(m)).alias("proba"), omega.alias("unc_comb"))
        )
    cells = F.array(*cells)
    fanned = unnest(rows, ["part", "y"], cells, "m").select("part", "y", "m.*")
    fanned = unnest(fanned, ["y", "method", "pred", "proba", "unc_comb"], F.array(F.lit("full"), F.col("part")), "subset")
    out = metrics.compute_metrics(fanned, k, ["subset", "method"], labels=list(range(k)), closed="right")
    return out.withColumnRenamed("unc_comb", "avg_omega")
