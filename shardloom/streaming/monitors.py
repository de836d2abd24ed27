"""Monitor reports as a stream: the same latest state of each node, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shardloom.plans.govern import latest_states


def watch(reports: DataFrame, node: str, at: str, *states: str, late: str = "10 minutes"):
    """A streaming query writer of ``latest_states`` over a stream of reports."""
    return latest_states(reports.withWatermark(at, late), node, at, *states).writeStream.outputMode("update")
