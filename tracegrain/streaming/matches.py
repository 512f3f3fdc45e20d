"""Rules and counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Rule, matches


def matched_stream(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches of each rule; without state."""
    return matches(events, rules)


def sessions_stream(matched: DataFrame, keys: list[str], gap: str, late: str, time_col: str = "timestamp_utc") -> DataFrame:
    """Clusters of a key's matches, closed once the watermark has passed them."""
    by_session = F.session_window(F.col(time_col), gap)
    return matched.withWatermark(time_col, late).groupBy("rule_key", *keys, by_session.alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select("rule_key", *keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")
