"""Frame plans, tiles, masks and schedules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import temporal as T
from sluice.functions.quantiles import beta_sigmas
from sluice.plans.catalog import Tables, query
from sluice.session import kept


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(range(9), lambda i: round_even(l_linenumber + i * l_quantity / 24.0, 0)::INT), ',') AS plan FROM lineitem")
def frame_resample_plan(t: Tables) -> DataFrame:
    plan = T.resample_plan(F.col("l_linenumber"), F.col("l_quantity"), 24.0, 9)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(plan.cast("array<string>"), ",").alias("plan"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN len(list_distinct(p)) < 9 THEN 'source_fps_too_low_for_unique_sampling' WHEN list_max(p) >= l_linenumber + 12 THEN 'insufficient_frames' END AS reason
FROM (SELECT *, list_transform(range(9), lambda i: round_even(l_linenumber + i * l_quantity / 24.0, 0)::INT) AS p FROM lineitem)""")
def plan_validity(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", T.resample_plan(F.col("l_linenumber"), F.col("l_quantity"), 24.0, 9).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", T.plan_reason(F.col("p"), F.col("l_linenumber") + 12).alias("reason"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(c), lambda x: {'at': list_position(c, x), 'x': x})), lambda s: s.x), ',') AS starts FROM (
  SELECT p_partkey, list_filter(list_concat(list_transform([0, -1, 1, -2, 2], lambda o: (p_size // 2) + o), list_transform([0, -1, 1, -2, 2], lambda o: 1 + o), list_transform([0, -1, 1, -2, 2], lambda o: p_size + o)), lambda s: s >= 1 AND s <= p_size) AS c FROM part)""")
def plan_candidates(t: Tables) -> DataFrame:
    starts = T.candidate_starts(F.floor(F.col("p_size") / 2).cast("int"), F.lit(1), F.col("p_size"))
    return t.part.select("p_partkey", F.array_join(starts.cast("array<string>"), ",").alias("starts"))


@query("SELECT p_partkey, array_to_string(list_transform(range(5), lambda i: round_even(i * (p_size - 1) / 4.0, 0)::INT), ',') AS anchors FROM part")
def uniform_anchor_indices(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(T.uniform_indices(F.col("p_size"), 5).cast("array<string>"), ",").alias("anchors"))


@query("SELECT p_partkey, array_to_string(list_concat([0], range(1, p_size, 8)), ',') AS picks FROM part")
def subsample_indices(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(T.aligned_subsample(F.col("p_size"), 8).cast("array<string>"), ",").alias("picks"))


@query("SELECT p_partkey, floor((p_size - 1) / 8)::BIGINT + 1 AS latent, (floor((p_size - 1) / 8)::BIGINT) * 8 + 1 AS frames, round_even(p_retailprice / 16.0, 0)::BIGINT AS audio FROM part")
def latent_shape(t: Tables) -> DataFrame:
    latent = T.latent_frames(F.col("p_size"))
    return t.part.select("p_partkey", latent.alias("latent"), ((latent - 1) * 8 + 1).alias("frames"), F.rint(F.col("p_retailprice") / 16.0).cast("long").alias("audio"))


@query("""SELECT p_partkey, i AS tile, CASE WHEN p_size <= 12 THEN 0 ELSE i * 8 END::INT AS start, CASE WHEN p_size <= 12 OR i = n - 1 THEN p_size ELSE i * 8 + 12 END::INT AS "end",
  CASE WHEN i = 0 THEN 0 ELSE 4 END::INT AS left_ramp, CASE WHEN p_size <= 12 OR i = n - 1 THEN 0 ELSE 4 END::INT AS right_ramp FROM (
  SELECT p_partkey, p_size, n, unnest(range(n))::INT AS i FROM (SELECT p_partkey, p_size, CASE WHEN p_size <= 12 THEN 1 ELSE floor((p_size + 12 - 8 - 1) / 8) END::INT AS n FROM part))""")
def split_by_size(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.posexplode(T.tiles_by_size(F.col("p_size"), 12, 4)).alias("tile", "x"))
    return rows.select("p_partkey", "tile", "x.*")


@query("""SELECT p_partkey, i AS tile, (i * (b - 2) + least(i, r))::INT AS start, (i * (b - 2) + least(i, r) + b + CASE WHEN i < r THEN 1 ELSE 0 END)::INT AS "end",
  CASE WHEN i = 0 THEN 0 ELSE 2 END::INT AS left_ramp, CASE WHEN i = 2 THEN 0 ELSE 2 END::INT AS right_ramp FROM (
  SELECT p_partkey, floor((p_size + 4) / 3)::INT AS b, ((p_size + 4) - floor((p_size + 4) / 3) * 3)::INT AS r, unnest(range(3))::INT AS i FROM part WHERE p_size >= 8)""")
def split_by_count(t: Tables) -> DataFrame:
    rows = t.part.where("p_size >= 8").select("p_partkey", F.posexplode(T.tiles_by_count(F.col("p_size"), 3, 2)).alias("tile", "x"))
    return rows.select("p_partkey", "tile", "x.*")


@query("""SELECT p_partkey, i, round(least(CASE WHEN i < 3 THEN (i + 1) / 4.0 ELSE 1.0 END, CASE WHEN i >= p_size - 3 THEN (p_size - i) / 4.0 ELSE 1.0 END), 6)::DOUBLE AS weight FROM (
  SELECT p_partkey, p_size, unnest(range(p_size))::INT AS i FROM part)""")
def blend_masks(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size", F.explode(T.indices(F.col("p_size"))).alias("i"))
    return rows.select("p_partkey", "i", F.round(T.trapezoid(F.col("i"), F.col("p_size"), F.lit(3), F.lit(3)), 6).alias("weight"))


@query("""SELECT p_partkey AS patch, greatest(0, f * 8 + 1 - 8) AS t_start, greatest(0, (f + 1) * 8 + 1 - 8) AS t_end, h * 32 AS y_start, (h + 1) * 32 AS y_end, w * 32 AS x_start, (w + 1) * 32 AS x_end
FROM (SELECT p_partkey, p_partkey // 64 AS f, p_partkey // 8 % 8 AS h, p_partkey % 8 AS w FROM part)""")
def patch_bounds_pixels(t: Tables) -> DataFrame:
    """Pixel bounds of the patch of each part's number in a grid of 8 x 8 a frame; the first covers one frame."""
    key = F.col("p_partkey")
    rows = t.part.select(key.alias("patch"), F.floor(key / 64).alias("f"), (F.floor(key / 8) % 8).alias("h"), (key % 8).alias("w"))
    (t0, t1), (y0, y1), (x0, x1) = T.patch_bounds(F.col("f"), 8, True), T.patch_bounds(F.col("h"), 32), T.patch_bounds(F.col("w"), 32)
    return rows.select("patch", t0.alias("t_start"), t1.alias("t_end"), y0.alias("y_start"), y1.alias("y_end"), x0.alias("x_start"), x1.alias("x_end"))


@query("""WITH s AS (SELECT p_partkey, p_size AS n, unnest(range(p_size + 1)) AS i FROM part), g AS (SELECT *, CASE WHEN i = n THEN 0.0 ELSE exp(1.1) / (exp(1.1) + (1 / (1.0 - i / n::DOUBLE) - 1)) END AS sigma FROM s)
SELECT p_partkey, i AS step, round(CASE WHEN sigma = 0 THEN 0.0 WHEN n = 1 THEN sigma ELSE 1 - (1 - sigma) * (1 - 0.1) / (1 - min(sigma) FILTER (sigma > 0) OVER (PARTITION BY p_partkey)) END, 8)::DOUBLE AS sigma FROM g""")
def sigma_schedule(t: Tables) -> DataFrame:
    """Shifted schedules of as many steps as a part is large, stretched to a terminal 0.1; one step is not stretched."""
    shifted = lambda i, n: T.shifted_sigma(1.0 - i / n, 1.1)
    n = F.col("p_size")
    last = shifted(n - 1, n)
    rows = t.part.select("p_partkey", "p_size").withColumn("step", F.explode(F.sequence(F.lit(0), n)))
    s = shifted(F.col("step"), n)
    return rows.select("p_partkey", "step", F.round(F.when(s == 0, 0.0).when(n == 1, s).otherwise(T.stretched(s, last, 0.1)), 8).alias("sigma"))


@query("""WITH s AS (SELECT p_partkey, p_size AS n, unnest(range(p_size)) AS i FROM part), k AS (SELECT DISTINCT p_partkey, round_even(round(sin(pi() * (1 - i / n::DOUBLE) / 2) * sin(pi() * (1 - i / n::DOUBLE) / 2), 11) * 9999, 0)::BIGINT AS k FROM s),
r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) - 1 AS step, exp(2.37) / (exp(2.37) + (10000.0 / (k + 1) - 1)) AS sigma FROM k)
SELECT p_partkey, step, round(sigma, 8)::DOUBLE AS sigma FROM r UNION ALL SELECT p_partkey, max(step) + 1, 0.0 FROM r GROUP BY 1""")
def beta_schedule(t: Tables) -> DataFrame:
    """Schedules by quantiles of beta(1/2, 1/2), whose closed form the SQL is; tests have other parameters."""
    sizes = t.part.select("p_size").distinct().repartition("p_size")
    schedules = kept(sizes.withColumn("sigmas", beta_sigmas(F.col("p_size"), 0.5, 0.5)), "schedules")  # one per number of steps
    rows = t.part.select("p_partkey", "p_size").join(schedules, "p_size")
    return rows.select("p_partkey", F.posexplode("sigmas").alias("step", "s")).select("p_partkey", "step", F.round("s", 8).alias("sigma"))


@query("SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN embedding[(floor(i * len(embedding) / 10.0)::INT) + 1] > 0.05 THEN '1' ELSE '0' END), '') AS mask FROM embeddings")
def nearest_resample(t: Tables) -> DataFrame:
    picks = T.nearest_resample(F.col("embedding"), 10)
    return t.embeddings.select("vec_id", F.array_join(F.transform(picks, lambda x: F.when(x.cast("double") > 0.05, "1").otherwise("0")), "").alias("mask"))


@query("""SELECT p_partkey, s AS start, greatest(s + 1, least(ceil((p_size + 10) / 8.0), 6))::BIGINT AS stop FROM (SELECT p_partkey, p_size, greatest(0, least(floor(p_size / 8.0), 5))::BIGINT AS s FROM part)""")
def region_mask_clamp(t: Tables) -> DataFrame:
    start, stop = T.to_latent_region(F.col("p_size"), F.col("p_size") + 10, 8, F.lit(6))
    return t.part.select("p_partkey", start.alias("start"), stop.alias("stop"))


@query("""SELECT p_partkey, w, h, round(greatest(832.0 / w, 480.0 / h), 6) AS scale, round(832.0 * 480 / (w * greatest(832.0 / w, 480.0 / h) * h * greatest(832.0 / w, 480.0 / h)), 6) AS retained,
  greatest(832.0 / w, 480.0 / h) > 1 AS upscaled FROM (SELECT p_partkey, 64 * (1 + p_partkey % 30) AS w, 48 * p_size AS h FROM part)""")
def crop_risk(t: Tables) -> DataFrame:
    """Scale to cover 832 x 480, area kept, and whether pixels are made up."""
    rows = t.part.select("p_partkey", (64 * (1 + F.col("p_partkey") % 30)).alias("w"), (48 * F.col("p_size")).alias("h"))
    scale = F.greatest(832.0 / F.col("w"), 480.0 / F.col("h"))
    return rows.select("p_partkey", "w", "h", F.round(scale, 6).alias("scale"), F.round(832.0 * 480 / (F.col("w") * scale * F.col("h") * scale), 6).alias("retained"), (scale > 1).alias("upscaled"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%H:%M:%S.%g') WHEN 1 THEN value::DECIMAL(18, 2)::VARCHAR || 's' ELSE (user_id * 10)::VARCHAR END AS code,
  round(CASE event_id % 3 WHEN 0 THEN (epoch_us(ts) // 1000) % 86400000 / 1000.0 WHEN 1 THEN value::DECIMAL(18, 2)::DOUBLE ELSE user_id * 10.0 END, 6)::DOUBLE AS seconds FROM events""")
def timecode_parse(t: Tables) -> DataFrame:
    """Clock times, seconds and frame numbers of the events."""
    kind = F.col("event_id") % 3
    code = F.when(kind == 0, F.date_format("ts", "HH:mm:ss.SSS")).when(kind == 1, F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("s"))).otherwise((F.col("user_id") * 10).cast("string"))
    return t.events.select("event_id", code.alias("code")).select("event_id", "code", F.round(T.timecode_seconds(F.col("code")), 6).alias("seconds"))
