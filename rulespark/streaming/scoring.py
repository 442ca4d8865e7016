"""Scoring of streaming rows with frozen rules.

Matching, fusion and prediction are row-local, so they run on a streaming DataFrame as they are, in
append mode and without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rulespark.operators.predict import score
from rulespark.rules import RuleSet


def score_stream(rows: DataFrame, rules: RuleSet, *, method: str = "dempster") -> DataFrame:
    if not rows.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame; use score for a batch")
    return score(rows, rules, method=method)


def write_scored(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to parquet, taking what is available now and stopping; safe to restart."""
    return (
        scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
