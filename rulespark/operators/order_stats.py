"""Running sums, exact quantiles and exact random draws without a global sort.

A window over one feature would put all its values into one task. Here values are first counted per
distinct value (map-side), then cut into buckets at approximate quantiles; each bucket is a window of
its own and starts from the total of the buckets before it. Results are exact whatever the cut points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.session import ensure_checkpoint_dir, small_side

ONE_WINDOW_MAX = 200_000
SKETCH_K = 4000  # of the sketch behind the brackets: ranks are off by about a thousandth
GRID = 1024  # ranks read from a sketch; a bracket is at least four of them wide


def finite_only(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def value_counts(cells: DataFrame, by: Sequence[str], *, value: str = "value", positive: Column | None = None) -> DataFrame:
    """Distinct values per group with n rows and pos rows satisfying `positive`."""
    hit = F.lit(False) if positive is None else positive
    return cells.groupBy(*by, value).agg(F.count("*").alias("n"), F.count_if(hit).alias("pos"))


def buckets_for(distinct_values: int) -> int:
    return 1 if distinct_values <= ONE_WINDOW_MAX else min(4096, distinct_values // ONE_WINDOW_MAX * 4 + 4)


def running(
    counts: DataFrame, by: Sequence[str], *, value: str = "value", sums: Sequence[str] = ("n", "pos"),
    leads: Sequence[str] = (), buckets: int = 1,
) -> DataFrame:
    """counts plus, per group in value order: cum_<s> (inclusive), all_<s> (group total), next_value and
    next_<c> for the columns in `leads`."""
    ahead = [value, *leads]
    next_name = lambda c: "next_value" if c == value else f"next_{c}"
    if buckets <= 1:
        up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        return counts.select(
            "*",
            *[F.sum(s).over(up_to).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
            *[F.lead(c).over(Window.partitionBy(*by).orderBy(value)).alias(next_name(c)) for c in ahead],
        )
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, cuts, 10_000).alias("bounds"))
    placed = counts.join(F.broadcast(bounds), list(by)).withColumn(
        "bucket", F.size(F.filter("bounds", lambda b: b < F.col(value)))
    ).drop("bounds")
    totals = placed.groupBy(*by, "bucket").agg(
        *[F.sum(s).alias(f"t_{s}") for s in sums], *[F.min_by(c, value).alias(f"first_{c}") for c in ahead]
    )
    # One row per (group, bucket): a few thousand rows whatever the data size.
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "bucket",
        *[F.coalesce(F.sum(f"t_{s}").over(before), F.lit(0)).alias(f"off_{s}") for s in sums],
        *[F.sum(f"t_{s}").over(Window.partitionBy(*by)).alias(f"all_{s}") for s in sums],
        *[F.lead(f"first_{c}").over(Window.partitionBy(*by).orderBy("bucket")).alias(f"_after_{c}") for c in ahead],
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(value)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(offsets), [*by, "bucket"]).select(
        *counts.columns,
        *[(F.sum(s).over(up_to) + F.col(f"off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
        *[F.coalesce(F.lead(c).over(inside), F.col(f"_after_{c}")).alias(next_name(c)) for c in ahead],
    )


def quantile_columns(qs: Sequence[float], *, value: str = "value", weight: str = "n", prefix: str = "q") -> list[Column]:
    """Aggregates over `running` rows: linearly interpolated quantiles of the expanded values."""
    out = []
    cum, size, v = F.col(f"cum_{weight}"), F.col(f"all_{weight}"), F.col(value)
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (size - 1)
        low = F.floor(at)
        a = F.min(F.when(cum > low, v))
        b = F.min(F.when(cum > F.least(low + 1, size - 1), v))
        t = F.max(at - low)
        out.append(F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t).alias(f"{prefix}{i}"))
    return out


def exact_quantiles(
    cells: DataFrame, by: Sequence[str], qs: Sequence[float], *, value: str = "value", prefix: str = "q", room: int = ONE_WINDOW_MAX,
    sketch_k: int = SKETCH_K,
) -> DataFrame:
    """One row per group with `size`, q0.. = exact quantiles of its finite values.

    Values leave a task only where they lie in a bracket around a wanted rank; all others are added up per gap between
    brackets. So what is shuffled does not grow with the distinct values, but with `room`, the rows a bracket may hold:
    larger tables narrow their brackets by further sketches of the rows inside, one scan each. The last scan proves that
    every wanted rank lies in its bracket; a group for which a sketch erred is counted by all its values.
    """
    rows = finite_only(cells, value).select(*by, F.col(value).cast("double").alias("value"))
    ensure_checkpoint_dir(cells.sparkSession)
    first = rows.groupBy(*by).agg(F.count("*").alias("size"), F.kll_sketch_agg_double("value", sketch_k).alias("s"))
    first = first.withColumn("g", F.kll_sketch_get_quantile_double("s", F.lit(_RANKS)))
    spans = first.select(*by, "size", *_narrowed(qs, lambda i: (F.lit(0), F.col("size"), F.col("g")))).checkpoint()
    largest = spans.agg(F.max("size")).first()[0] or 0
    width = largest * 6 / GRID
    while width > room:
        spans = _narrow(rows, by, qs, spans, room, sketch_k).checkpoint()
        width *= 6 / GRID
    counts = _bracketed_counts(rows, by, spans)
    runs = running(counts, by, sums=["n"])
    at = [F.floor(F.lit(float(q)) * (F.col("all_n") - 1)) for q in qs]
    ranks = F.array(*at, *[F.least(a + 1, F.col("all_n") - 1) for a in at])
    lost = ~F.col("exact") & F.exists(ranks, lambda r: (r >= F.col("cum_n") - F.col("n")) & (r < F.col("cum_n")))
    found = runs.groupBy(*by).agg(F.max(lost).alias("lost"), F.max("all_n").alias("size"), *quantile_columns(qs, prefix=prefix)).checkpoint()
    again = found.where("lost").select(*by)
    if not again.isEmpty():
        plain = value_counts(_joined(rows, by, again), by)
        redone = running(plain, by, sums=["n"], buckets=buckets_for(largest)).groupBy(*by).agg(
            F.max("all_n").alias("size"), *quantile_columns(qs, prefix=prefix)
        )
        found = found.where("NOT lost").drop("lost").unionByName(redone)
    return found.drop("lost")


_RANKS = [i / GRID for i in range(GRID + 1)]


def _narrowed(qs: Sequence[float], source) -> list[Column]:
    """lo and hi per quantile from `source(i)`: rows below the sketched ones, their number and their values at _RANKS."""
    lows, highs = [], []
    for i, q in enumerate(qs):
        below, inside, grid = source(i)
        low = F.floor(F.lit(float(q)) * (F.col("size") - 1))
        high = F.least(low + 1, F.col("size") - 1)
        lows.append(F.get(grid, F.greatest(F.lit(0), F.floor((low - below) / inside * GRID) - 2).cast("int")))
        highs.append(F.get(grid, F.least(F.lit(GRID), F.ceil((high + 1 - below) / inside * GRID) + 2).cast("int")))
    return [F.array(*lows).alias("lo"), F.array(*highs).alias("hi")]


def _joined(rows: DataFrame, by: Sequence[str], groups: DataFrame) -> DataFrame:
    """rows of the given groups (a row each, null keys too) with the groups' columns."""
    side = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(side[f"_{c}"])
    return rows.join(small_side(side), on).drop(*[f"_{c}" for c in by])


def _narrow(rows: DataFrame, by: Sequence[str], qs: Sequence[float], spans: DataFrame, room: int, sketch_k: int) -> DataFrame:
    """Narrower brackets by a sketch of what each holds; one that misses its rank opens on that side."""
    found = []
    for i in range(len(qs)):
        lo, hi, v = F.get("lo", F.lit(i)), F.get("hi", F.lit(i)), F.col("value")
        held = F.when((v >= lo) & (v <= hi), v)
        found += [F.count_if(v < lo).alias(f"b{i}"), F.count(held).alias(f"n{i}"), F.kll_sketch_agg_double(held, sketch_k).alias(f"s{i}")]
    got = _joined(rows, by, spans).groupBy(*by, "size", "lo", "hi").agg(*found)
    fresh = _narrowed(qs, lambda i: (
        F.col(f"b{i}"), F.col(f"n{i}"),
        F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.lit(_RANKS))),
    ))
    got = got.select("*", fresh[0].alias("lo1"), fresh[1].alias("hi1"))
    lows, highs = [], []
    for i, q in enumerate(qs):
        low = F.floor(F.lit(float(q)) * (F.col("size") - 1))
        high = F.least(low + 1, F.col("size") - 1)
        early, late = low < F.col(f"b{i}"), high >= F.col(f"b{i}") + F.col(f"n{i}")
        dense = ~early & ~late & (F.col(f"n{i}") > room)
        pick = lambda c: F.when(dense, F.get(f"{c}1", F.lit(i))).otherwise(F.get(c, F.lit(i)))
        lows.append(F.when(early, F.lit(-math.inf)).otherwise(pick("lo")))
        highs.append(F.when(late, F.lit(math.inf)).otherwise(pick("hi")))
    return got.select(*by, "size", F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


def _bracketed_counts(rows: DataFrame, by: Sequence[str], spans: DataFrame) -> DataFrame:
    """(by, value, n, exact): rows per value inside any bracket; the rows of a gap are one row under its largest value."""
    v = F.col("value")
    inside = F.exists(F.arrays_zip("lo", "hi"), lambda s: (s["lo"] <= v) & (s["hi"] >= v))
    gap = F.size(F.filter("lo", lambda x: x > v))  # no bracket begins between two rows of one gap
    placed = _joined(rows, by, spans).select(*by, "value", F.when(inside, v).alias("_own"), F.when(~inside, gap).alias("_gap"))
    counts = placed.groupBy(*by, "_own", "_gap").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    return counts.select(*by, "value", "n", F.col("_own").isNotNull().alias("exact"))


# --- exact seeded draws ---

HASH_BUCKETS = 4096


def row_hash(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*key, F.lit(seed))


def hash_cuts(df: DataFrame, group: str, key: Sequence[str], wanted: dict, seed: int, *, rank_at_most: int = 200_000) -> DataFrame:
    """(g, cut): per group the row-hash value at or below which exactly `wanted[group]` rows lie.

    Every pass counts rows per slice of the hash range and keeps the slice holding the cut, until few enough rows are
    left to rank; no row of the table is moved, and one row per group comes back, so groups may be many. A group
    nothing is wanted of has no row. Keys must be unique.
    """
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), row_hash(key, seed).alias("h"))
    table = lambda items: F.broadcast(spark.createDataFrame(items, f"k {kind}, slice bigint, want bigint"))
    cuts: list[tuple] = []
    # open groups: (group, slice of the last pass that holds the cut, rows still wanted inside it); a row per group
    spans, at = [(g, None, int(k)) for g, k in wanted.items() if k > 0], None
    for bits in (52, 40, 28, 16, 4, 0):
        if not spans:
            break
        inside = _within(rows, table(spans), at)
        counts = inside.groupBy("g", "want", F.shiftright("h", bits).alias("b")).count()
        up_to = F.sum("count").over(Window.partitionBy("g").orderBy("b"))
        hold = counts.withColumn("upto", up_to).where("upto >= want AND upto - count < want")
        found = {r["g"]: r for r in hold.collect()}
        ready, fresh = [], []
        for g, _, k in spans:
            r = found.get(g)
            if r is None:  # fewer rows than wanted: all of them
                cuts.append((g, 2**63 - 1))
                continue
            span = (g, r["b"], k - (r["upto"] - r["count"]))
            (ready if r["count"] <= rank_at_most or bits == 0 else fresh).append(span)
        if ready:
            rank = F.row_number().over(Window.partitionBy("g").orderBy("h"))
            ends = _within(rows, table(ready), bits).withColumn("r", rank).where("r = want")
            cuts += [(r["g"], r["h"]) for r in ends.select("g", "h").collect()]
        spans, at = fresh, bits
    return spark.createDataFrame(cuts, f"g {kind}, cut bigint")


def _within(rows: DataFrame, spans: DataFrame, bits: int | None) -> DataFrame:
    same = F.col("g").eqNullSafe(F.col("k"))
    if bits is not None:
        same = same & (F.shiftright("h", bits) == F.col("slice"))
    return rows.join(spans, same).select("g", "h", "want")


def with_drawn(df: DataFrame, group: str, key: Sequence[str], seed: int, cuts: DataFrame, out: str) -> DataFrame:
    """df plus `out`, true on the rows drawn by `hash_cuts`. The cuts are one row per group, broadcast: no row moves."""
    side = F.broadcast(cuts.select(F.col("g").alias("_cut_group"), F.col("cut").alias("_cut")))
    drawn = F.coalesce(row_hash(key, seed) <= F.col("_cut"), F.lit(False))
    return df.join(side, F.col(group).eqNullSafe(F.col("_cut_group")), "left").withColumn(out, drawn).drop("_cut_group", "_cut")


def number_rows(df: DataFrame, key: Sequence[str], seed: int, *, buckets: int = HASH_BUCKETS) -> DataFrame:
    """df plus `idx`, 0..N-1 in hash order: each bucket is numbered on its own and shifted."""
    placed = df.withColumn("_h", row_hash(key, seed)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    totals = placed.groupBy("_b").count()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))  # <= `buckets` rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key)) - 1
    return placed.join(F.broadcast(offsets), "_b").withColumn("idx", rank + F.col("_off")).drop("_h", "_b", "_off")


def draw_with_replacement(df: DataFrame, key: Sequence[str], size: int, n_draws: int, seed: int) -> DataFrame:
    """Exactly `n_draws` rows of df drawn with replacement; `size` is df's row count."""
    spark = df.sparkSession
    draws = (
        spark.range(n_draws)
        .select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)).alias("idx"))
        .groupBy("idx")
        .agg(F.count("*").alias("copies"))
    )
    picked = number_rows(df, key, seed + 1).join(small_side(draws), "idx")
    return picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*df.columns)
