"""Class probabilities and labels from fused evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.functions import mass as M
from rulespark.operators import forest
from rulespark.operators.fuse import _known, dempster_vec, fuse_yager, vote_vec, with_evidence
from rulespark.rules import RuleSet
from rulespark.session import ensure_checkpoint_dir

METHODS = ("dempster", "yager", "vote", "first")


def unc_rule(evidence: str = "evidence") -> Column:
    """Mean omega of the fired rules, 1 when none fired."""
    n = F.col(f"{evidence}.n_fired")
    return F.when(n > 0, F.col(f"{evidence}.sum_omega") / F.greatest(n, F.lit(1))).otherwise(F.lit(1.0))


def mass_vec(method: str, n_classes: int) -> M.Vec:
    if method == "dempster":
        return dempster_vec(n_classes)
    if method == "vote":
        return vote_vec(n_classes)
    return M.unpack(F.col("yager"), n_classes + 1)


def score(df: DataFrame, rules: RuleSet, *, method: str = "dempster", form: str | None = None) -> DataFrame:
    """df plus n_fired, mass, proba, pred, unc_rule, unc_comb. Row-local: also valid on streams."""
    k = rules.n_classes
    _known(method, ("dempster", "yager", "vote"))
    out = with_evidence(df, rules, form=form)
    if method == "yager":
        out = fuse_yager(out, rules, form=form)
    m = mass_vec(method, k)
    # Omega is shared equally, so the top class is that of the evidence itself: no need to go through
    # the probabilities, and filters on `pred` stay small when the optimizer pushes them down.
    ranking = {"dempster": "evidence.log_ratio", "vote": "evidence.votes", "yager": "yager"}[method]
    return out.select(
        *df.columns,
        F.col("evidence.n_fired").alias("n_fired"),
        F.array(*m).alias("mass"),
        F.array(*M.pignistic(m)).alias("proba"),
        M.argmax(M.unpack(F.col(ranking), k)).alias("pred"),
        unc_rule().alias("unc_rule"),
        m[-1].alias("unc_comb"),
    )


def predict_first_rule(df: DataFrame, rules: RuleSet, *, form: str | None = None) -> DataFrame:
    """Label of the first fired labelled rule in rule order, else the default label."""
    out = with_evidence(df, rules, form=form)
    label = F.coalesce(F.col("evidence.first_label"), F.lit(rules.default_label)).cast("int")
    return out.select(*df.columns, label.alias("pred"))


def predict_vote(df: DataFrame, rules: RuleSet, *, form: str | None = None) -> DataFrame:
    """Majority label of the fired rules, the default label when no rule fired."""
    out = with_evidence(df, rules, form=form)
    votes = M.unpack(F.col("evidence.votes"), rules.n_classes)
    label = F.when(F.col("evidence.n_fired") > 0, M.argmax(votes)).otherwise(F.lit(rules.default_label))
    return out.select(*df.columns, label.cast("int").alias("pred"))


def first_hit_vec(label: Column, n_classes: int, *, top: float = 0.9) -> M.Vec:
    """Fixed smoothing of a hard label: `top` on it, (1 - top) / K everywhere else, renormalised."""
    raw = [F.when(label == c, F.lit(top)).otherwise(F.lit((1.0 - top) / n_classes)) for c in range(n_classes)]
    return M.divide(raw, M.total(raw))


def first_hit_laplace_vec(label: Column, precision: Column, n_classes: int) -> M.Vec:
    """Smoothing by the firing rule's own counts: its Laplace precision on the label, the rest shared."""
    rest = (1.0 - precision) / (n_classes - 1)
    return [F.when(label == c, precision).otherwise(rest) for c in range(n_classes)]


def class_counts(df: DataFrame, label: str = "y") -> DataFrame:
    return df.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))


def class_prior(df: DataFrame, label: str = "y", *, power: float | None = None) -> DataFrame:
    """Per class: inverse-count prior, or (N / n)^(0.5 + power) when `power` is given; sums to 1."""
    everything = Window.partitionBy()
    n = F.sum("n").over(everything)
    raw = 1.0 / F.col("n") if power is None else F.pow(n / F.col("n"), F.lit(0.5 + power))
    weighted = class_counts(df, label).withColumn("raw", raw)
    return weighted.select("y", "n", (F.col("raw") / F.sum("raw").over(everything)).alias("prior"))


def class_weights(df: DataFrame, label: str = "y", *, power: float = 0.5) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy())
    return class_counts(df, label).select("y", "n", F.pow(n / F.col("n"), F.lit(power)).alias("weight"))


FOREST_ROWS = 16_384  # training rows of a partition, at least; fewer than twice as many stay where they are, with the draws they had
FOREST_PARTS = 24  # partitions: each adds up its own counts of all open nodes, so more of them are only for more cores
NODE_IDS = 1 << 31  # bytes up to which every row's node in every tree is kept between passes
PATTERNS = 1 << 23  # distinct binned rows up to which a tree is grown by one task, which holds them


def spread(train: DataFrame, n_rows: int) -> DataFrame:
    """train on enough partitions for the trees' passes, which adaptive execution leaves on one while the rows are few megabytes."""
    parts = min(n_rows // FOREST_ROWS, max(FOREST_PARTS, train.sparkSession.sparkContext.defaultParallelism))
    return train.repartition(parts, *train.columns).sortWithinPartitions(*train.columns) if parts > 1 else train


def _by_passes(train: DataFrame, test: DataFrame, features: Sequence[str], n_rows: int, *, trees: int, depth: int, bins: int, seed: int) -> DataFrame:
    """test plus the library's forest's class shares `rf_p`."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(features), outputCol="rf_features")
    keep_ids = 4 * trees * n_rows <= NODE_IDS
    if keep_ids:
        ensure_checkpoint_dir(train.sparkSession)  # their lineage is cut there
    model = RandomForestClassifier(
        featuresCol="rf_features", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, probabilityCol="rf_raw", predictionCol="rf_label",
        cacheNodeIds=keep_ids,
    ).fit(assemble.transform(spread(train, n_rows)))
    return model.transform(assemble.transform(test)).withColumn("rf_p", vector_to_array("rf_raw"))


def _by_tasks(train: DataFrame, test: DataFrame, features: Sequence[str], *, trees: int, depth: int, bins: int, seed: int) -> DataFrame | None:
    """test plus the class shares `rf_p` of trees grown by a task each; none if the rows have too many distinct codes for one task."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    cuts = forest.cut_points(train, features, bins)
    found = forest.patterns(train, features, cuts).checkpoint()
    size = found.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.min("y").alias("least")).first()
    if size["n"] > PATTERNS:
        return None
    if size["least"] < 0:
        raise ValueError("labels of the forest are numbered from 0")
    grown = forest.grow_all(found.toArrow(), spark, cuts, size["y"] + 1, trees=trees, depth=depth, seed=seed)
    return test.withColumn("rf_p", forest.shares(grown, cuts, features, spark))


def random_forest_baseline(
    train: DataFrame, test: DataFrame, features: Sequence[str], n_classes: int, *, trees: int = 400, depth: int = 30, bins: int = 128, seed: int = 42
) -> DataFrame:
    """test plus `rf_proba` (K classes, floored at 1e-12 and renormalised) and `rf_pred`.

    Trees grow until their leaves are pure, as far as `depth` lets them; 30 is the most that the library allows. Small tables and those of
    more than PATTERNS distinct binned rows go by the library's passes over all rows, whose draws follow the partitions and the order in
    them, which `spread` fixes. In between, tasks grow whole trees (`forest`); their draws follow seed and tree.
    """
    n_rows = train.count()
    out = _by_tasks(train, test, features, trees=trees, depth=depth, bins=bins, seed=seed) if n_rows >= 2 * FOREST_ROWS else None
    if out is None:
        out = _by_passes(train, test, features, n_rows, trees=trees, depth=depth, bins=bins, seed=seed)
    p = [F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1e-12)) for x in M.unpack(F.col("rf_p"), n_classes)]
    out = out.withColumn("rf_proba", F.array(*M.divide(p, M.total(p))))
    pred = M.argmax(M.unpack(F.col("rf_proba"), n_classes))
    return out.withColumn("rf_pred", pred).select(*test.columns, "rf_proba", "rf_pred")
