"""Ordered computations: occurrence numbers, islands, rates, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.identity import with_row_index
from sluice.operators.ranges import equal_runs, folded, numbered
from sluice.plans.catalog import Tables, query


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT - 1 AS occurrence FROM events")
def occurrence_number(t: Tables) -> DataFrame:
    """The place of each event among its user's; a hot user is dealt over many tasks."""
    return numbered(t.events.select("event_id", "user_id"), ["user_id"], ["event_id"], "occurrence")


@query("""SELECT user_id, event_type, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events) GROUP BY user_id, event_type, island""")
def gaps_and_islands_runs(t: Tables) -> DataFrame:
    """Runs of equal event types of each user."""
    got = equal_runs(t.events, "user_id", "event_id", "event_type")
    return got.withColumnsRenamed({"first": "first_event", "last": "last_event"})


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, turn)::INT AS pos FROM conversations")
def right_pad_order(t: Tables) -> DataFrame:
    """Valid tokens first, each part in its order."""
    w = Window.partitionBy("conv_id").orderBy((F.col("role") == "user").desc(), "turn")
    return t.conversations.select("conv_id", "turn", F.row_number().over(w).alias("pos"))


@query("SELECT user_id, bool_and(coalesce(value > p, true)) AS increasing, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id")
def adjacent_increasing_check(t: Tables) -> DataFrame:
    """Whether each event's value is above the one before; null values and what stands beside them pass."""
    rows = t.events.select("user_id", "event_id", "value")
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))

    def combine(acc, part):
        meets = F.coalesce(part["first"] > acc["last"], F.lit(True))
        return F.struct((acc["ok"] & part["ok"] & meets).alias("ok"), (acc["n"] + part["n"]).alias("n"), part["last"].alias("last"))

    columns = lambda w: {"p": F.lag("value").over(w), "at": F.row_number().over(w)}
    summary = {"ok": F.bool_and(F.coalesce(F.col("value") > F.col("p"), F.lit(True))), "n": F.count(F.lit(1)), "first": F.min_by("value", "at"), "last": F.max_by("value", "at")}
    return folded(rows, ["user_id"], ["event_id"], columns, summary, start, combine, "r").select("user_id", F.col("r.ok").alias("increasing"), F.col("r.n").alias("n"))


@query("""SELECT h, n, round(coalesce(n - p, 0) / 3600.0, 6) AS delta_rate, round(total / (3600.0 * r), 6) AS mean_rate FROM (
  SELECT h, n, lag(n) OVER (ORDER BY h) AS p, sum(n) OVER (ORDER BY h) AS total, row_number() OVER (ORDER BY h) AS r FROM (
    SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1))""")
def progress_rate_eta(t: Tables) -> DataFrame:
    """Hourly counts with current and mean rates; the window runs over one row per hour."""
    hours = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("h")
    return hours.select("h", "n", F.round(F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)) / 3600.0, 6).alias("delta_rate"), F.round(F.sum("n").over(w) / (3600.0 * F.row_number().over(w)), 6).alias("mean_rate"))


@query("""SELECT user_id, round(sum(value * pow(0.5::DOUBLE, age)), 4) AS momentum FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events WHERE value IS NOT NULL) GROUP BY user_id""")
def ema_fold(t: Tables) -> DataFrame:
    """The recurrence avg = avg / 2 + x over each user's events in order: a stretch of n events is the map avg -> avg / 2^n + b."""
    rows = t.events.where("value is not null").select("user_id", "event_id", "value")

    def columns(w):
        return {"x": F.col("value") * F.pow(F.lit(0.5), F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing)))}

    summary = {"n": F.count(F.lit(1)), "b": F.sum("x")}
    got = folded(rows, ["user_id"], ["event_id"], columns, summary, F.lit(0.0), lambda acc, part: acc * F.pow(F.lit(0.5), part["n"]) + part["b"], "momentum")
    return got.select("user_id", F.round("momentum", 4).alias("momentum"))


@query("SELECT doc_id, floor((i * 7 + 6) / (SELECT count(*) FROM documents))::BIGINT AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def shard_assignment(t: Tables) -> DataFrame:
    """Contiguous shards with bounds floor(k * N / 7)."""
    docs = t.documents.select("doc_id")
    n = docs.count()
    return with_row_index(docs, ["doc_id"], "i").select("doc_id", F.floor((F.col("i") * 7 + 6) / F.lit(max(n, 1))).alias("shard"))


@query("SELECT doc_id, i % 5 AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def interleaved_shard(t: Tables) -> DataFrame:
    return with_row_index(t.documents.select("doc_id"), ["doc_id"], "i").select("doc_id", F.pmod("i", F.lit(5)).alias("rank"))


@query("SELECT s.user_id, s.n::INT AS n, s.event_id AS start_event, e.event_id AS end_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') s JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') e USING (user_id, n)")
def start_end_pairing(t: Tables) -> DataFrame:
    """The n-th start of a user with the n-th end; both sides are dealt over ranges, and joined by user and n."""
    of = lambda kind, name: numbered(t.events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name)), ["user_id"], [name], "n")
    met = of("click", "start_event").join(of("purchase", "end_event"), ["user_id", "n"])
    return met.select("user_id", (F.col("n") + 1).alias("n"), "start_event", "end_event")


@query("SELECT o_custkey, o_orderkey, floor(r / 4)::BIGINT AS epoch, (r % 4)::INT AS cursor FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)")
def epoch_cursor(t: Tables) -> DataFrame:
    rows = numbered(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "r")
    return rows.select("o_custkey", "o_orderkey", F.floor(F.col("r") / 4).alias("epoch"), (F.col("r") % 4).alias("cursor"))
