"""Adapters, state and conversion operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import numeric as N
from sluice.operators import tokens as K
from sluice.operators import stitching as Z
from sluice.operators import visibility as Y
from sluice.plans.catalog import Tables, query
from sluice.sources.adapters import Settings, normalize


@query("""SELECT l_orderkey || '-' || l_linenumber AS source_record_id, CASE WHEN l_returnflag = 'R' THEN 'empty_caption'
  WHEN l_quantity <= 5 THEN 'invalid_crop' WHEN l_linenumber >= 6 THEN 'invalid_face_cut' END AS reason, '/data/v' || l_partkey || '.mp4' AS target_path, 5.0::DOUBLE AS x0, l_quantity AS x1, l_linenumber::BIGINT AS clip_start_frame FROM lineitem""")
def opens2v_normalize(t: Tables) -> DataFrame:
    """Line items as video annotations: captions, crops (x0, x1, y0, y1) and cuts are checked."""
    raw = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_record_id"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string"), F.lit(".mp4")).alias("video_path"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("text"),
        F.array(F.lit(5.0), F.col("l_quantity"), F.lit(0.0), F.lit(9.0)).alias("crop"),
        F.array(F.col("l_linenumber").cast("long"), F.lit(6).cast("long")).alias("face_cut"),
        F.array(F.lit("r.png")).alias("ref_images"),
    )
    got = normalize(raw, "opens2v", Settings(data_root="/data"))
    return got.select("source_record_id", "reason", "target_path", F.get("crop_xyxy", 0).alias("x0"), F.get("crop_xyxy", 2).alias("x1"), "clip_start_frame")


@query("""SELECT c AS source_record_id, CASE WHEN n = 0 THEN 'phantom_missing_reference' END AS reason, refs FROM (
  SELECT conv_id::VARCHAR AS c, count(*) FILTER (role <> 'system' AND turn > 0) AS n, coalesce(string_agg(DISTINCT '/d/' || role, ',' ORDER BY '/d/' || role) FILTER (role <> 'system' AND turn > 0), '') AS refs FROM conversations GROUP BY 1)""")
def phantom_normalize(t: Tables) -> DataFrame:
    """Conversations as records with repeated references: ordered distinct, empty ones rejected."""
    roles = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: (x.role != "system") & (x.turn > 0)), lambda x: x.role)
    raw = t.conversations.groupBy("conv_id").agg(roles.alias("refs"))
    raw = raw.select(F.col("conv_id").alias("source_record_id"), F.lit("v.mp4").alias("video_path"), F.struct(F.lit("text").alias("video_caption")).alias("metadata"), F.col("refs").alias("cropped_ref_paths"), F.lit("pair").alias("cross_pair"))
    got = normalize(raw, "phantom", Settings(data_root="/d"))
    return got.select("source_record_id", "reason", F.array_join(F.sort_array("reference_paths"), ",").alias("refs"))


@query("SELECT event_id, round(CASE WHEN x > 0.010591 THEN 0.247190 * log10(5.555556 * x + 0.052272) + 0.385537 ELSE 5.367655 * x + 0.092809 END, 6) AS encoded, true AS inverts FROM (SELECT event_id, value / 100.0 AS x FROM events WHERE value IS NOT NULL)")
def log_encoding(t: Tables) -> DataFrame:
    x = F.col("value") / 100.0
    y = N.log_encode(x)
    return t.events.where("value is not null").select("event_id", F.round(y, 6).alias("encoded"), (F.abs(N.log_decode(y) - x) < 1e-4).alias("inverts"))


@query("SELECT p_partkey, round((0.2126 * r + 0.7152 * g + 0.0722 * b) * 219 + 16, 4) AS y, round((b - (0.2126 * r + 0.7152 * g + 0.0722 * b)) / (2 * (1 - 0.0722)) * 224 + 128, 4) AS u FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS r, (p_partkey % 10) / 10.0::DOUBLE AS g, 0.5::DOUBLE AS b FROM part)")
def rgb_to_yuv(t: Tables) -> DataFrame:
    y, u, _ = N.yuv(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, F.lit(0.5))
    return t.part.select("p_partkey", F.round(y, 4).alias("y"), F.round(u, 4).alias("u"))


@query("SELECT vec_id, round(e[1] + 0.7071067811865476 * (e[3] + e[5]), 6) AS l, round(e[2] + 0.7071067811865476 * (e[3] + e[6]), 6) AS r FROM (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::DOUBLE) AS e FROM embeddings)")
def downmix_stereo(t: Tables) -> DataFrame:
    left, right = N.downmix(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", F.round(left, 6).alias("l"), F.round(right, 6).alias("r"))


@query("""WITH c AS (SELECT conv_id, turn AS p, role <> 'system' AS ok, role = 'assistant' AS img, turn - row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) AS run FROM conversations),
f AS (SELECT q.conv_id, q.p AS q_p, k.p AS k_p, q.img AND k.img AS both_img, q.ok AND k.ok AND (k.p <= q.p OR (q.img AND k.img AND q.run = k.run)) AS "full" FROM c q JOIN c k USING (conv_id))
SELECT conv_id, q_p, k_p, "full", "full" AND ((k_p <= q_p AND q_p - k_p < 2) OR (both_img AND abs(q_p - k_p) < 2)) AS sliding FROM f""")
def combined_visibility(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.col("role") != "system").alias("valid"), (F.col("role") == "assistant").alias("image"))
    return K.visibility(rows, "conv_id", "turn", "valid", "image", 2)


@query("SELECT user_id, round(sum(w * d * d) / greatest(sum(w), 1.0), 6) AS by_sum, round(avg(w * d * d) / greatest(avg(w), 1e-8), 6) AS by_mean FROM (SELECT user_id, (value - 50) / 10.0 AS d, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS w FROM events) GROUP BY user_id")
def masked_losses(t: Tables) -> DataFrame:
    d, w = (F.col("value") - 50) / 10.0, F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0)
    return t.events.groupBy("user_id").agg(F.round(K.masked_mse(d, w), 6).alias("by_sum"), F.round(K.masked_mse_by_mean(d, w), 6).alias("by_mean"))


@query("""SELECT conv_id, turn, round(CASE WHEN turn % 2 = 0 THEN 0.7 * turn + 0.3 * 100 ELSE 100.0 END, 6)::DOUBLE AS x, round(CASE WHEN turn % 2 = 0 THEN 0.3 * 0.5 ELSE 0.5 END, 6)::DOUBLE AS ts, turn % 2 <> 0 AS in_loss FROM conversations""")
def conditioned_tokens(t: Tables) -> DataFrame:
    x, ts, loss = K.conditioned(F.col("turn") % 2 == 0, F.lit(0.7), F.col("turn").cast("double"), F.lit(100.0), F.lit(0.5))
    return t.conversations.select("conv_id", "turn", F.round(x, 6).alias("x"), F.round(ts, 6).alias("ts"), loss.alias("in_loss"))


@query("""SELECT path, step FROM (SELECT *, row_number() OVER (ORDER BY step DESC) AS n FROM (SELECT 'ckpt/model_' || o_orderkey || '.bin' AS path, o_orderkey AS step FROM orders)) WHERE n <= 3 OR path = 'ckpt/model_7.bin'""")
def checkpoint_retention(t: Tables) -> DataFrame:
    paths = t.orders.select(F.concat(F.lit("ckpt/model_"), "o_orderkey", F.lit(".bin")).alias("path"))
    return K.retained(paths, "path", 3, "ckpt/model_7.bin").select("path", "step")


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN 'caption_too_long' WHEN n_chars % 6 NOT BETWEEN 1 AND 4 THEN 'reference_count_out_of_range' WHEN n_chars % 6 = 4 THEN 'reference_aliases_target' END AS reason FROM documents")
def selection_candidates(t: Tables) -> DataFrame:
    from sluice.operators.validate import selection_reason

    refs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("n_chars") % 6).cast("int"))), lambda i: i.cast("string"))
    refs = F.when(F.col("n_chars") % 6 == 0, F.array().cast("array<string>")).otherwise(refs)
    return t.documents.select("doc_id", selection_reason(F.col("text"), refs, F.lit("4"), 3000).alias("reason")).withColumn("reason", F.col("reason"))


@query("""WITH c AS (SELECT conv_id, turn AS p, role <> 'system' AS ok, role = 'assistant' AS img FROM conversations), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS n, p - row_number() OVER (PARTITION BY conv_id, img ORDER BY p) AS run FROM c WHERE ok),
pre AS (SELECT q.conv_id, 'prefix' AS part, q.n, count(*) AS visible, sum(k.n) AS keys FROM v q JOIN v k ON q.conv_id = k.conv_id AND (k.n <= q.n OR (q.img AND k.img AND q.run = k.run)) GROUP BY ALL),
l AS (SELECT conv_id, count(*) FILTER (ok) AS m, 1 + conv_id % 3 AS frames FROM c GROUP BY conv_id), b AS (SELECT conv_id, m, m + f * 320 AS base FROM l, unnest(range(frames)) AS x(f)),
e AS (SELECT conv_id, 'evidence' AS part, base + i AS n, m + 256 AS visible, m * (m - 1) // 2 + 256 * base + 256 * 255 // 2 AS keys FROM b, unnest(range(256)) AS y(i)),
u AS (SELECT conv_id, 'query' AS part, base + 256 + i AS n, m + 5 AS visible, m * (m - 1) // 2 + base + 256 + i + (SELECT sum(base + (2 * (i // 8) + r) * 16 + 2 * (i % 8) + d) FROM unnest(range(2)) AS r1(r), unnest(range(2)) AS d1(d)) AS keys FROM b, unnest(range(64)) AS y(i))
SELECT conv_id, part, n::BIGINT AS n, visible::BIGINT AS visible, keys::BIGINT AS keys FROM pre UNION ALL SELECT * FROM e UNION ALL SELECT * FROM u""")
def teacher_visibility(t: Tables) -> DataFrame:
    """How many keys each token of a prefix with one to three frames sees, and the sum of their numbers, from lists of ranges."""
    rows = t.conversations.select("conv_id", "turn", (F.col("role") != "system").alias("valid"), (F.col("role") == "assistant").alias("image"))
    frames = rows.select("conv_id").distinct().withColumn("frames", (1 + F.col("conv_id") % 3).cast("int"))
    got = Y.teacher_ranges(rows, frames, "conv_id", "turn", "valid", "image")
    total = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + F.floor((r.start + r.end - 1) * (r.end - r.start) / 2))
    return got.select("conv_id", "part", "n", Y.visible(F.col("ranges")).alias("visible"), total.alias("keys"))


@query("""SELECT vec_id, i::INT AS cell, round(embedding[i + 1]::DOUBLE / (1 + 1e-8), 5) + 0.0 AS value, 1.0::DOUBLE AS total FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""")
def stitched_tiles(t: Tables) -> DataFrame:
    """Vectors cut into tiles of 10 that share 3 cells, and put together again with ramps from their neighbours."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tiles = rows.select("vec_id", F.explode(Z.tile_bounds(F.size("v"), 10, 3)).alias("t"), "v").select("vec_id", "t.*", F.slice("v", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")).alias("x"))
    return Z.stitched(tiles, ["vec_id"], "x").select("vec_id", "cell", F.round("value", 5).alias("value"), F.round("total", 9).alias("total"))
