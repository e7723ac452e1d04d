"""Token sequences, masks and run policies on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.ranges import numbered
from sluice.plans.catalog import Tables, query


@query("SELECT conv_id, turn, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS seen FROM conversations")
def sliding_visibility(t: Tables) -> DataFrame:
    """The keys a query sees in a causal window of three: a bounded window frame, no pairs."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("turn").over(w).cast("array<string>"), ",").alias("seen"))


@query("SELECT conv_id, turn, turn < 2 AS prefix, turn >= n - 2 AS suffix, turn + 1 > 1 AND turn < 3 AS region FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def temporal_region_masks(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    turn = F.col("turn")
    return t.conversations.select("conv_id", "turn", (turn < 2).alias("prefix"), (turn >= n - 2).alias("suffix"), ((turn + 1 > 1) & (turn < 3)).alias("region"))


@query("SELECT user_id % 8 AS cell, CASE WHEN hour(ts) = 0 THEN 0 ELSE ceil(hour(ts) / 8.0) END::BIGINT AS g, round(avg(value), 4) AS pooled FROM events GROUP BY 1, 2")
def causal_mask_pool(t: Tables) -> DataFrame:
    """Frame 0 alone, then means of groups of eight frames."""
    f = F.hour("ts")
    return t.events.groupBy((F.col("user_id") % 8).alias("cell"), F.ceil(f / 8.0).alias("g")).agg(F.round(F.avg("value"), 4).alias("pooled"))


@query("""SELECT conv_id, array_to_string(list_concat(k, list_transform(range(m - len(k)), lambda i: -1)), ',') AS packed FROM (SELECT conv_id, k, max(len(k)) OVER (PARTITION BY conv_id % 5) AS m FROM (
  SELECT conv_id, list(turn ORDER BY turn) AS k FROM conversations WHERE role <> 'system' GROUP BY 1))""")
def pack_kept_tokens(t: Tables) -> DataFrame:
    from sluice.functions.arrays import pad_to

    kept = t.conversations.where("role <> 'system'").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("k")).withColumn("b", F.col("conv_id") % 5)
    met = kept.join(kept.groupBy("b").agg(F.max(F.size("k")).alias("m")), "b")
    return met.select("conv_id", F.array_join(pad_to(F.col("k"), F.col("m"), F.lit(-1).cast("long")).cast("array<string>"), ",").alias("packed"))


@query("""SELECT a.conv_id, a.turn, b.turn AS source_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') a
JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') b USING (conv_id, n)""")
def scatter_by_order(t: Tables) -> DataFrame:
    """The n-th open place takes the n-th valid token."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    of = lambda role, name: t.conversations.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name), F.row_number().over(w).alias("n"))
    return of("assistant", "turn").join(of("user", "source_turn"), ["conv_id", "n"]).select("conv_id", "turn", "source_turn")


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN (value - 50) * (value - 50) ELSE 0 END) / greatest(count(*) FILTER (event_type = 'click'), 1), 6) AS mse FROM events GROUP BY user_id")
def masked_mse(t: Tables) -> DataFrame:
    on = F.col("event_type") == "click"
    d = F.col("value") - 50
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.when(on, d * d).otherwise(0.0)) / F.greatest(F.count_if(on), F.lit(1)), 6).alias("mse"))


@query("SELECT source, arg_max(doc_id, (n_chars % 1000) * 1000000000 + doc_id) AS latest FROM documents GROUP BY source")
def latest_by_suffix(t: Tables) -> DataFrame:
    """The entry with the largest numeric suffix, ties to the larger id."""
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(F.col("n_chars") % 1000, "doc_id")).alias("latest"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source, i % 4 AS rank, i // 4 AS round, doc_id, true AS save FROM d
UNION ALL SELECT source, i % 4, i // 4, (SELECT max(doc_id) FROM d WHERE d.source = n.source), false FROM n, unnest(range(n, ceil(n / 4.0)::BIGINT * 4)) AS x(i)""")
def work_split_padded(t: Tables) -> DataFrame:
    """Each source's documents round-robin over four ranks; ranks without one in the last round repeat the last document and do not save it."""
    rows = numbered(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], "i")
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id"))
    short = sizes.where(F.col("n") % 4 > 0).withColumn("i", F.explode(F.sequence("n", F.ceil(F.col("n") / 4) * 4 - 1)))  # three a source at most
    every = rows.select("source", "i", "doc_id", F.lit(True).alias("save")).unionAll(short.select("source", "i", "doc_id", F.lit(False)))
    return every.select("source", (F.col("i") % 4).alias("rank"), F.floor(F.col("i") / 4).alias("round"), "doc_id", "save")


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'skip' WHEN l.quality = 1 THEN 'fail_complete' WHEN l.quality = 0 AND d.doc_id % 3 <> 0 THEN 'fail_partial' ELSE 'run' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def run_policy_status(t: Tables) -> DataFrame:
    """Complete and resumable: skip; complete: fail; partial without overwrite: fail; else run."""
    met = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    complete, partial = F.col("quality") == 1, F.col("quality") == 0
    return met.select("doc_id", F.when(complete & (F.col("doc_id") % 2 == 0), "skip").when(complete, "fail_complete").when(partial & (F.col("doc_id") % 3 != 0), "fail_partial").otherwise("run").alias("status"))


@query("SELECT conv_id, turn, CASE WHEN turn BETWEEN 1 AND 2 THEN 'replaced' ELSE role END AS state, least(2560, ceil((turn + 1) / 128.0) * 128)::BIGINT AS prefix_len, turn % 3 <> 0 AS skip_step FROM conversations")
def token_range_state(t: Tables) -> DataFrame:
    """Replace a range of tokens, round a prefix up to 128, and mark skipped steps."""
    turn = F.col("turn")
    return t.conversations.select("conv_id", "turn", F.when(turn.between(1, 2), "replaced").otherwise(F.col("role")).alias("state"), F.least(F.lit(2560), F.ceil((turn + 1) / 128.0) * 128).alias("prefix_len"), (turn % 3 != 0).alias("skip_step"))
