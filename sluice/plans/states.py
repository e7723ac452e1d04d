"""Keyed state with rules of its own, over the events table taken in stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.catalog import Tables, query
from sluice.streaming.state import collisions, consumed_sets, first_by_position, firsts, progress, run_in_stages, stage_count

STAGES = 3


def _in_order(t: Tables) -> list[DataFrame]:
    """The events as ranges of their ids, oldest first; each has a bounded number of rows."""
    n = stage_count(t.events.count(), STAGES)
    cuts = t.events.agg(F.percentile_approx("event_id", [(i + 1) / n for i in range(n - 1)]).alias("c")).first().c
    edges = [None, *(cuts or []), None]
    stages = []
    for low, high in zip(edges, edges[1:]):
        part = t.events
        part = part if low is None else part.where(F.col("event_id") > low)
        stages.append(part if high is None else part.where(F.col("event_id") <= high))
    return stages


def _out_of_order(t: Tables) -> list[DataFrame]:
    """The events in stages that a hash deals, so that earlier positions come later, too."""
    return [t.events.where(F.pmod(F.xxhash64("event_id"), F.lit(STAGES)) == k) for k in range(STAGES)]


@query("SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY ALL")
def stream_first_by_position(t: Tables) -> DataFrame:
    """The first row by position of each key, whatever order rows arrive in."""
    got = run_in_stages(t.spark, _out_of_order(t), lambda s: first_by_position(s, F.concat_ws("|", "user_id", "event_type"), F.col("event_id")))
    return firsts(got).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT user_id || '|' || date_trunc('day', ts)::DATE AS key FROM events GROUP BY user_id, date_trunc('day', ts) HAVING count(DISTINCT event_type) > 1""")
def stream_collisions(t: Tables) -> DataFrame:
    """Keys (a user's day) whose rows name different plans, each reported once."""
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return run_in_stages(t.spark, _out_of_order(t), lambda s: collisions(s, key, F.col("event_type"), fail=False)).select("key")


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
r AS (SELECT key, 0::BIGINT AS i, us AS at, -1::BIGINT AS position, '' AS "by", 0::BIGINT AS since FROM e WHERE i = 1
  UNION ALL SELECT r.key, min(e.i), arg_min(e.us, e.i), arg_min(e.event_id, e.i), CASE WHEN min(e.i) - r.i >= 60 THEN 'rows' ELSE 'time' END, min(e.i) - r.i
  FROM r JOIN e ON e.key = r.key AND e.i > r.i AND (e.i - r.i >= 60 OR e.us - r.at >= 43200000000) GROUP BY r.key, r.i)
SELECT key, position, i AS processed, since AS rows_since, "by" FROM r WHERE i > 0""")
def stream_progress_events(t: Tables) -> DataFrame:
    """Progress of each event type every 60 rows or twelve hours of event time, over several runs."""
    got = run_in_stages(t.spark, _in_order(t), lambda s: progress(s, F.col("event_type"), F.col("event_id"), F.col("ts"), 60, 43_200))
    return got.select("key", "position", "processed", "rows_since", "by")


@query("""SELECT event_type AS key, event_id // 500 AS step, event_id AS position, user_id AS index, row_number() OVER (PARTITION BY event_type, event_id // 500, user_id ORDER BY event_id) = 1 AS fresh FROM events""")
def stream_consumed_sets(t: Tables) -> DataFrame:
    """Rows of each stream that a step already took; the set is dropped when the next step begins, also between runs."""
    got = run_in_stages(t.spark, _in_order(t), lambda s: consumed_sets(s, F.col("event_type"), F.floor(F.col("event_id") / 500), F.col("event_id"), F.col("user_id")))
    return got.select("key", "step", "position", "index", "fresh")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def stream_resumed_runs(t: Tables) -> DataFrame:
    """A query that is stopped and goes on when new files are there takes in every row once."""
    got = run_in_stages(t.spark, _out_of_order(t), lambda s: s.select("event_type", "event_id"))
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
