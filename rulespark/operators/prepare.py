"""Profiling, cleaning, encoding and splitting of raw tables.

Decisions about columns (drop, label, kind) are made at the driver from one aggregated row; the data
itself is only ever projected, filtered and joined to dictionaries whose size is checked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rulespark.operators.breaks import break_values
from rulespark.operators import order_stats as O
from rulespark.operators.activate import melt
from rulespark.session import ensure_checkpoint_dir, fits_broadcast, small_side

ID_WORDS = ("id", "uid", "identifier")
# Preferred label names, fixed values.
LABEL_NAMES = ("label", "labels", "class", "target", "outcome", "diagnosis", "y", "result", "income", "chd")
# Columns that leak the target, per dataset: fixed values.
DATASET_EXCLUDES = {"df_wine": ("good",)}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def _fields(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _fields(df, (*_INTEGERS, *_FLOATS))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = set(_fields(df, (T.FloatType, T.DoubleType)))
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def has_id_name(name: str) -> bool:
    plain = name.strip().lower()
    words = [w for w in re.split(r"[^a-z0-9]+", plain) if w]
    return plain.startswith("id_") or plain.endswith("_id") or any(w in ID_WORDS for w in words)


def id_like_columns(df: DataFrame) -> list[str]:
    """Columns named like an id, or integers holding each of 0..n-1 (or 1..n) exactly once.

    Distinct values are counted only for columns whose minimum, maximum and row count already fit.
    """
    named = [c for c in df.columns if has_id_name(c)]
    ints = [c for c in _fields(df, _INTEGERS) if c not in named]
    if not ints:
        return named
    row = df.agg(
        F.count("*").alias("n"), *[f(c).alias(f"{a}_{i}") for i, c in enumerate(ints) for a, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    n = row["n"]
    spans = [c for i, c in enumerate(ints) if n and row[f"lo_{i}"] in (0, 1) and row[f"hi_{i}"] == row[f"lo_{i}"] + n - 1]
    counters = [c for c in spans if df.select(c).distinct().count() == n]
    return [c for c in df.columns if c in named or c in counters]


def drop_id_like(df: DataFrame) -> DataFrame:
    return df.drop(*id_like_columns(df))


def drop_excluded(df: DataFrame, dataset: str, excludes: Mapping[str, Sequence[str]] = DATASET_EXCLUDES) -> DataFrame:
    return df.drop(*excludes.get(dataset.lower(), ()))


def small_distinct_counts(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Exact number of distinct non-NULL, non-NaN values where it is at most `limit`; limit + 1 stands for more.

    A sketch rules out wide columns first; only the few narrow ones are counted exactly.
    """
    if not columns:
        return {}
    floats = set(_fields(df, (T.FloatType, T.DoubleType)))
    clean = {c: F.nanvl(F.col(c), F.lit(None)) if c in floats else F.col(c) for c in columns}
    sketch = df.agg(*[F.approx_count_distinct(clean[c], 0.02).alias(str(i)) for i, c in enumerate(columns)]).first()
    narrow = [c for i, c in enumerate(columns) if sketch[str(i)] <= 2 * limit + 8]
    if not narrow:
        return {c: limit + 1 for c in columns}
    exact = df.agg(*[F.count_distinct(clean[c]).alias(str(i)) for i, c in enumerate(narrow)]).first()
    return {c: min(exact[str(narrow.index(c))], limit + 1) if c in narrow else limit + 1 for c in columns}


def pick_label(df: DataFrame) -> str:
    """Preferred name, else the only or most balanced two-valued non-float column, else the last column
    with 2..10 values, else the last column."""
    for c in df.columns:
        if c.strip().lower() in LABEL_NAMES:
            return c
    counts = small_distinct_counts(df, df.columns, 10)
    floats = set(_fields(df, _FLOATS))
    binary = [c for c in df.columns if counts[c] == 2 and c not in floats]
    if len(binary) == 1:
        return binary[0]
    if binary:
        share = {
            c: abs(df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.max("count") / F.sum("count")).first()[0] - 0.5)
            for c in binary
        }
        return min(binary, key=share.get)
    small = [c for c in df.columns if 2 <= counts[c] <= 10]
    return small[-1] if small else df.columns[-1]


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(y, label_value): classes numbered in sorted order. Labels are few, so one small window numbers them."""
    values = df.select(F.col(label).alias("label_value")).distinct()
    return values.select((F.row_number().over(Window.orderBy("label_value")) - 1).alias("y"), "label_value")


def factorize_label(df: DataFrame, label: str, *, max_classes: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """df with `label` replaced by code `y`, and the label dictionary."""
    n = df.select(label).distinct().limit(max_classes + 1).count()
    if n < 2 or n > max_classes:
        raise ValueError(f"label {label!r} has {'too few' if n < 2 else 'too many'} classes")
    dim = label_dictionary(df, label)
    coded = df.join(F.broadcast(dim), df[label].eqNullSafe(dim["label_value"])).drop("label_value", label)
    return coded, dim


def value_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, code, value): every distinct string of a column with its rank, 0-based."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.feature", "p.value").where("value IS NOT NULL").distinct()
    # Written once: every column's join reads the dictionary, not the table it came from.
    ensure_checkpoint_dir(df.sparkSession)
    values = values.checkpoint()
    size = values.count()
    if size <= O.ONE_WINDOW_MAX:
        code = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
        return values.select("feature", code.alias("code"), "value")
    return _bucketed_codes(values, size)


def _bucketed_codes(values: DataFrame, size: int) -> DataFrame:
    """Codes for very wide dictionaries: values are cut at a hash-chosen sample of themselves."""
    step = max(1, size // 1000)
    cuts = values.where(F.pmod(F.xxhash64("value"), F.lit(step)) == 0).groupBy("feature").agg(
        F.array_sort(F.collect_list("value")).alias("cuts")
    )
    placed = values.join(F.broadcast(cuts), "feature", "left").select(
        "feature", "value", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0)).alias("bucket")
    )
    totals = placed.groupBy("feature", "bucket").count()
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("feature", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("feature", "bucket").orderBy("value")) - 1
    return placed.join(F.broadcast(offsets), ["feature", "bucket"]).select(
        "feature", (rank + F.col("off")).cast("int").alias("code"), "value"
    )


SALTS = 32


def _look_up(df: DataFrame, key: str, entries: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """df left-joined to entries (_v, _c) on key = _v: broadcast where they fit, else spread over `salts`.

    A column's most frequent value, and all its NULLs, would each meet the dictionary in one task. Rows get a salt from
    their other columns and the dictionary is repeated for each, so that a hot value is `salts` keys.
    """
    if fits_broadcast(entries):
        return df.join(F.broadcast(entries), F.col(key) == F.col("_v"), "left")
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = entries.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, (F.col(key) == F.col("_v")) & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy")


def encode_with_dictionary(
    df: DataFrame, value_dim: DataFrame, columns: Sequence[str], *, unknown: str = "code", trim: bool = False
) -> DataFrame:
    """Replace strings by their codes as doubles. Unseen values become -1 (`unknown="code"`) or, with
    `unknown="parse"`, the number they spell or 0."""
    if unknown not in ("code", "parse"):
        raise ValueError("unknown must be 'code' or 'parse'")
    out = df
    for c in columns:
        dim = value_dim.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        raw = F.col(c).cast("string")
        key = F.trim(raw) if trim else raw
        other = F.lit(-1.0) if unknown == "code" else F.coalesce(raw.try_cast("double"), F.lit(0.0))
        joined = _look_up(out.withColumn("_k", key), "_k", dim)
        out = joined.withColumn(c, F.coalesce(F.col("_c").cast("double"), other)).drop("_k", "_v", "_c")
    return out


def encode_categoricals(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    columns = list(columns) if columns is not None else _fields(df, T.StringType)
    dim = value_dictionary(df, columns)
    return encode_with_dictionary(df, dim, columns), dim


def encode_outliers(df: DataFrame, label: str, label_dim: DataFrame, value_dim: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Apply trained codes to new rows: rows with an unknown label go, helper columns go, the rest turns numeric."""
    known = small_side(label_dim.select("y", F.trim(F.col("label_value").cast("string")).alias("_lv")))
    rows = df.join(known, F.trim(F.col(label).cast("string")) == F.col("_lv")).drop("_lv", label, "sample_idx")
    rows = rows.drop(*[c for c in rows.columns if c.startswith("__")])
    numeric = [c for c in rows.columns if c not in categorical and c != "y"]
    coded = encode_with_dictionary(rows, value_dim, categorical, trim=True)
    return coded.select(
        *[F.col(c).cast("string").try_cast("double").alias(c) if c in numeric else F.col(c) for c in coded.columns]
    )


def decode_features(df: DataFrame, value_dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes back to their strings; codes without an entry are shown as they are."""
    out = df
    for c in columns:
        dim = value_dim.where(F.col("feature") == c).select(F.col("code").cast("bigint").alias("_v"), F.col("value").alias("_c"))
        out = _look_up(out.withColumn("_k", F.col(c).cast("bigint")), "_k", dim)
        out = out.withColumn(c, F.coalesce(F.col("_c"), F.col(c).cast("string"))).drop("_k", "_c", "_v")
    return out


def standardize_stats(df: DataFrame, columns: Sequence[str], *, eps: float = 0.0) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, NaN skipped; a deviation at or below `eps` becomes 1."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    row = df.agg(*[f(x).alias(f"{a}{i}") for i, x in enumerate(clean) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] and row[f"s{i}"] > eps else 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(
        *[((F.col(c).cast("double") - stats[c][0]) / stats[c][1]).alias(c) if c in stats else F.col(c) for c in df.columns]
    )


def test_sizes(counts: Mapping, test_size: float) -> dict:
    """Test rows per class: proportional shares, the rows lost to rounding going to the largest remainders."""
    n = sum(counts.values())
    want = math.ceil(test_size * n)
    share = {c: want * k / n for c, k in counts.items()}
    sizes = {c: math.floor(s) for c, s in share.items()}
    by_rest = sorted(counts, key=lambda c: (-(share[c] - sizes[c]), str(c)))
    for c in by_rest[: want - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(
    df: DataFrame, key: Sequence[str], label: str = "y", *, test_size: float = 0.16, seed: int = 42, stratify: bool = True
) -> DataFrame:
    """df plus `part` ('train' or 'test') with exact test sizes per class, decided by a seeded hash of the key.

    Falls back to one common pool when a class has fewer than two rows.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    group = label
    if not stratify or min(counts.values()) < 2:
        df = df.withColumn("_all", F.lit(0))
        group, counts = "_all", {0: sum(counts.values())}
    cuts = O.hash_cuts(df, group, key, test_sizes(counts, test_size), seed)
    part = F.when(F.col("_test"), "test").otherwise("train")
    return O.with_drawn(df, group, key, seed, cuts, "_test").withColumn("part", part).drop("_all", "_test")


def modulus_split(df: DataFrame, key: str, *, every: int = 5) -> DataFrame:
    """A split any engine reproduces: every n-th key is test."""
    return df.withColumn("part", F.when(F.pmod(F.col(key), F.lit(every)) == 0, "test").otherwise("train"))


def train_val_split(df: DataFrame, key: Sequence[str], *, val_split: float = 0.2, seed: int = 42) -> DataFrame:
    """df plus `is_val`: max(1, round(share * N)) rows, at most N - 1; every row when no share is asked."""
    if val_split <= 0:
        return df.withColumn("is_val", F.lit(False))
    n = df.count()
    want = min(max(1, round(val_split * n)), n - 1)
    pooled = df.withColumn("_all", F.lit(0))
    cuts = O.hash_cuts(pooled, "_all", key, {0: want}, seed)
    return O.with_drawn(pooled, "_all", key, seed, cuts, "is_val").drop("_all")


def upsample_minority(
    df: DataFrame, key: Sequence[str], label: str = "y", *, target: float = 0.35, seed: int = 42
) -> DataFrame:
    """Add positives drawn with replacement until their share is `target`; unchanged when it already is."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    n, pos = row["n"], row["pos"]
    need = round(target * n / (1 - target)) - pos
    if not pos or pos / max(1, n) >= target or need <= 0:
        return df
    return df.unionByName(O.draw_with_replacement(df.where(F.col(label) == 1), key, pos, need, seed))


def dataset_profile(df: DataFrame, features: Sequence[str], label: str = "y", *, categorical: Sequence[str] = ()) -> DataFrame:
    """One row: sizes, class balance, counts of numeric / discrete / two-valued features and regime flags."""
    finite = df.select(
        *[F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")).alias(c) for c in features]
    )
    counts = small_distinct_counts(finite, features, 20)
    whole = finite.agg(*[F.max(F.abs(F.col(c) - F.round(F.col(c)))).alias(str(i)) for i, c in enumerate(features)]).first()
    binary = sum(counts[c] <= 2 for c in features)
    discrete = sum(
        counts[c] <= 2 or c in categorical or (counts[c] <= 20 and (whole[str(i)] or 0.0) <= 1e-8)
        for i, c in enumerate(features)
    )
    d, numeric = len(features), len(features) - discrete
    k, n, top = F.col("n_classes"), F.col("n_samples"), F.col("majority_ratio")
    classes = df.groupBy(label).agg(F.count("*").alias("c"))
    base = classes.agg(
        F.sum("c").alias("n_samples"), F.count("*").alias("n_classes"), (F.max("c") / F.sum("c")).alias("majority_ratio")
    )
    return base.select(
        n, F.lit(d).alias("n_features"), k, top,
        F.lit(numeric).alias("num_like"), F.lit(discrete).alias("disc_like"), F.lit(binary).alias("bin_like"),
        (k == 2).alias("binary_task"),
        F.lit(d <= 8 and numeric >= discrete).alias("low_d_continuous"),
        F.lit(discrete >= numeric + 4).alias("categorical_heavy"),
        F.lit(numeric >= 32).alias("high_dim_continuous"),
        (top >= 0.80).alias("imbalanced"),
        (n < 1500).alias("small_dataset"),
        ((k == 2) & (n >= 5000)).alias("threshold_tuning_candidate"),
    )


def infer_feature_schema(df: DataFrame, features: Sequence[str], *, max_choices: int = 12) -> DataFrame:
    """Feature kinds: for a numeric feature one row with min, max, default (median) and step, for a
    categorical one a row per choice. Choices stay rows, as a text column may have any number of them."""
    texts = [c for c in features if c in _fields(df, (T.StringType, T.BooleanType))]
    numbers = [c for c in features if c not in texts]
    counts = small_distinct_counts(df, numbers, max_choices)
    parts = []
    if numbers:
        row = df.agg(*[F.max(F.abs(F.col(c) - F.round(F.col(c).cast("double")))).alias(str(i)) for i, c in enumerate(numbers)]).first()
        whole = {c: (row[str(i)] or 0.0) <= 1e-8 for i, c in enumerate(numbers)}
        texts += [c for c in numbers if whole[c] and counts[c] <= max_choices]
        numbers = [c for c in numbers if c not in texts]
    if numbers:
        stats = O.exact_quantiles(melt(df, [], numbers), ["feature"], [0.0, 0.5, 1.0])
        stats = stats.select("feature", F.col("q0").alias("min"), F.col("q1").alias("median0"), F.col("q2").alias("max"))
        is_whole = F.col("feature").isin([c for c in numbers if whole[c]] or [""])
        step = F.when(is_whole, 1.0).otherwise(F.greatest((F.col("max") - F.col("min")) / 100.0, F.lit(0.01)))
        parts.append(
            stats.select(
                "feature", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("choice"), "min", "max",
                F.col("median0").alias("default"), step.alias("step"),
            )
        )
    if texts:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("choice")) for c in texts]))
        values = df.select(pairs.alias("p")).select("p.*").where("choice IS NOT NULL").distinct()
        nothing = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "default", "step")]
        parts.append(values.select("feature", F.lit("categorical").alias("kind"), "choice", *nothing))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_schema_of_model(spark, features: Sequence[str], value_dim: DataFrame) -> DataFrame:
    """The same from a trained model: a row per dictionary entry, or one row for an open numeric feature."""
    names = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string")
    return names.join(value_dim, "feature", "left").select(
        "position", "feature", F.when(F.col("code").isNull(), "numeric").otherwise("categorical").alias("kind"), "code",
        F.col("value").alias("choice"),
    )


def feature_kinds(df: DataFrame, features: Sequence[str], *, cat_threshold: int = 32, require_integer: bool = True, dictionary: Sequence[str] = ()) -> dict[str, str]:
    """'categorical' or 'numeric' per feature: dictionary features and those with few (integer) values."""
    counts = small_distinct_counts(df, [f for f in features if f not in dictionary], cat_threshold)
    off = {}
    if require_integer and counts:
        row = df.agg(*[F.max(F.abs(F.col(c) - F.round(F.col(c).cast("double")))).alias(str(i)) for i, c in enumerate(counts)]).first()
        off = {c: row[str(i)] or 0.0 for i, c in enumerate(counts)}
    few = lambda f: counts[f] <= cat_threshold and (not require_integer or off[f] <= 1e-8)
    return {f: "categorical" if f in dictionary or few(f) else "numeric" for f in features}


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *features)


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def statistic_breaks(df: DataFrame, columns: Sequence[str], *, k: int = 5, sigma_tol: float = 2.0) -> DataFrame:
    """(feature, pos, threshold): k evenly spaced points over mean +- sigma_tol deviations."""
    stats = melt(df, [], columns).groupBy("feature").agg(
        F.avg(F.nanvl("value", F.lit(None))).alias("mu"), F.stddev_pop(F.nanvl("value", F.lit(None))).alias("sd")
    )
    low = F.col("mu") - F.col("sd") * sigma_tol
    width = F.col("sd") * (2 * sigma_tol / max(1, k - 1))
    return stats.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "feature", "pos", (low + width * F.col("pos")).alias("threshold")
    )


def natural_breaks(df: DataFrame, column: str, *, k: int = 5, append_infinity: bool = False) -> DataFrame:
    """(pos, threshold): the largest value of each cluster of the one-dimensional k-means of least cost, ascending."""
    found = break_values(df, column, k)
    if append_infinity and found:
        found[-1] = float("inf")
    return df.sparkSession.createDataFrame(list(enumerate(found)), "pos int, threshold double")


def filter_by_rule_confidence(df: DataFrame, predicate: Column, *, cluster: str = "cluster_id", by_proportion: bool = True) -> DataFrame:
    """Rows where `predicate` holds -> one row: dominant cluster, its confidence and the three-way split.

    Confidence is 1 minus the mean `distance_norm` inside the dominant cluster, times its share.
    """
    distance = F.col("distance_norm")
    broken = df.agg(F.count_if(distance.isNull() | F.isnan(distance) | (F.abs(distance) == float("inf")))).first()[0]
    if broken:
        raise ValueError("distance_norm contains missing or infinite values")
    groups = df.where(predicate).groupBy(F.col(cluster).alias("dominant")).agg(F.count("*").alias("n"), F.avg("distance_norm").alias("d"))
    best = groups.agg(
        F.max_by(F.struct("dominant", "n", "d"), F.struct("n", -F.col("dominant"))).alias("b"), F.sum("n").alias("all")
    ).where("`all` IS NOT NULL")
    share = F.col("b.n") / F.col("all") if by_proportion else F.lit(1.0)
    conf = F.least(F.greatest((1.0 - F.col("b.d")) * share, F.lit(0.0)), F.lit(1.0))
    out = best.select(F.col("b.dominant").alias("dominant"), F.col("all").alias("n_rows"), conf.alias("confidence"))
    rest = (1.0 - F.col("confidence")) / 2.0
    place = F.when(F.col("dominant").isin(0, 1), F.col("dominant")).otherwise(2)
    return out.select("*", *[F.when(place == i, F.col("confidence")).otherwise(rest).alias(f"p{i}") for i in range(3)])
