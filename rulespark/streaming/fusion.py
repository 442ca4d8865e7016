"""Fusing evidence over event time: the belief of each key in each window of a stream.

Dempster's mass of any number of fired rules depends only on L_k = sum ln(1 + m_k / omega), so what a window has to remember is
K sums and three counts, however many events and rules fall into it. Those are ordinary sums: tasks add up
their own events first, the state store holds one small row per open window and key, windows of a session merge by adding,
and a restart goes on from the checkpoint. A watermark closes windows; events behind it are dropped and counted.

The same function takes a batch DataFrame and then gives every window, late or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rulespark.functions import mass as M
from rulespark.operators.fuse import with_evidence
from rulespark.rules import RuleSet

METHODS = ("dempster", "vote")


def utc_instant(wall: Column) -> Column:
    """A timestamp without a zone read as UTC, whatever the session's zone: watermarks need instants."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def utc_wall(instant: Column) -> Column:
    """The UTC wall clock of an instant, as a timestamp without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def event_window(time: str, size: str, *, slide: str | None = None, session: bool = False) -> Column:
    """Tumbling windows, sliding ones with `slide`, or sessions closed by a gap of `size`."""
    if session:
        if slide is not None:
            raise ValueError("a session has no slide")
        return F.session_window(F.col(time), size)
    return F.window(F.col(time), size, slide)


def without_repeats(events: DataFrame, time: str, lateness: str, event_id: Sequence[str]) -> DataFrame:
    """Each event once. In a stream an id is remembered until the watermark has passed its time, in a batch always."""
    if not events.isStreaming:
        return events.dropDuplicates(list(event_id))
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(event_id))


def fuse_windows(
    events: DataFrame, rules: RuleSet, by: Sequence[str], *, time: str, size: str, slide: str | None = None, session: bool = False,
    lateness: str = "0 seconds", event_id: Sequence[str] = (), method: str = "dempster",
) -> DataFrame:
    """One row per window and key: window_start, window_end, n_events, n_fired, unc_rule, mass, proba, pred, unc_comb.

    `unc_rule` is the mean omega of the fired rules, 1 when none fired; `mass` holds the K classes and omega. With
    `event_id`, repeated deliveries count once. Events without a time belong to no window. Yager's rule is not
    associative, so it has no state that windows could share; `method` is dempster or vote.
    """
    if method not in METHODS:
        raise ValueError(f"unknown {method!r}, expected one of {', '.join(METHODS)}")
    k = rules.n_classes
    if event_id:
        events = without_repeats(events, time, lateness, event_id)
    elif events.isStreaming:
        events = events.withWatermark(time, lateness)
    field = "log_ratio" if method == "dempster" else "votes"
    scored = with_evidence(events.where(F.col(time).isNotNull()), rules)
    part = lambda c: F.get(F.col("evidence")[field], F.lit(c))
    sums = scored.groupBy(event_window(time, size, slide=slide, session=session).alias("window"), *by).agg(
        F.count("*").alias("n_events"), F.sum("evidence.n_fired").alias("n_fired"), F.sum("evidence.sum_omega").alias("omegas"),
        *[F.sum(part(c)).alias(f"part{c}") for c in range(k)],
    )
    parts = [F.col(f"part{c}") for c in range(k)]
    fused = sums.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_events", "n_fired",
        F.when(F.col("n_fired") > 0, F.col("omegas") / F.col("n_fired")).otherwise(F.lit(1.0)).alias("unc_rule"),
        F.array(*(M.from_log_ratios(parts) if method == "dempster" else _shares(parts))).alias("mass"),
    )
    mass = M.unpack(F.col("mass"), k + 1)
    fused = fused.withColumn("proba", F.array(*M.pignistic(mass)))
    return fused.withColumn("pred", M.argmax(M.unpack(F.col("proba"), k))).withColumn("unc_comb", F.get("mass", F.lit(k)))


def _shares(votes: M.Vec) -> M.Vec:
    seen = M.total(votes)
    return [*[F.when(seen > 0, v / F.greatest(seen, F.lit(1.0))).otherwise(F.lit(0.0)) for v in votes], F.when(seen > 0, F.lit(0.0)).otherwise(F.lit(1.0))]


def write_windows(fused: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to parquet, taking what is available now and stopping. Started again with the same
    checkpoint it takes only what is new, and open windows go on from their sums."""
    return (
        fused.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the recent batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
