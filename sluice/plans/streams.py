"""Structured Streaming runs of the engine's stream operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.catalog import Tables, query
from sluice.streaming.progress import first_wins, hourly_progress, run_once


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_first_wins_dedup(t: Tables) -> DataFrame:
    """Any first seen row of each key; only the keys are the same in every run."""
    return run_once(t.spark, t.sf_dir, "events", lambda s: first_wins(s, ["user_id", "event_type"]).select("user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS h, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1")
def stream_progress_window(t: Tables) -> DataFrame:
    """Hourly progress in complete mode, so the last windows are there, too."""
    return run_once(t.spark, t.sf_dir, "events", hourly_progress, "complete")
