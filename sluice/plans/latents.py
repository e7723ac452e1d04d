"""Latent grids, tiles, schedules, token states and step recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import arrays as A
from sluice.functions import numeric as N
from sluice.operators import latents as L
from sluice.operators import temporal as T
from sluice.operators import tokens as K
from sluice.plans.catalog import Tables, query

_TILES = "SELECT p_partkey, i, n, CASE WHEN p_size <= 12 THEN 0 ELSE i * 8 END AS s, CASE WHEN p_size <= 12 OR i = n - 1 THEN p_size ELSE i * 8 + 12 END AS e, CASE WHEN i = 0 THEN 0 ELSE 4 END AS l, CASE WHEN i = n - 1 THEN 0 ELSE 4 END AS r FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT p_partkey, p_size, CASE WHEN p_size <= 12 THEN 1 ELSE (p_size + 3) // 8 END AS n FROM part))"


@query(f"""SELECT p_partkey, i::INT AS tile, (s - (i > 0)::INT)::INT AS start, e::INT AS "end", (l + (i > 0)::INT)::INT AS left_ramp, r::INT AS right_ramp FROM ({_TILES})""")
def split_causal(t: Tables) -> DataFrame:
    """Tiles of a causal time axis."""
    rows = t.part.select("p_partkey", F.posexplode(L.causal_tiles(T.tiles_by_size(F.col("p_size"), 12, 4))).alias("tile", "x"))
    return rows.select("p_partkey", "tile", "x.*")


@query(f"""SELECT p_partkey, i::INT AS tile, s::INT AS start, (e + (i < n - 1)::INT)::INT AS "end", l::INT AS left_ramp, 0 AS right_ramp FROM ({_TILES})""")
def split_frames(t: Tables) -> DataFrame:
    """Tiles in frames."""
    rows = t.part.select("p_partkey", F.posexplode(L.frame_tiles(T.tiles_by_size(F.col("p_size"), 12, 4))).alias("tile", "x"))
    return rows.select("p_partkey", "tile", "x.*")


@query("""SELECT p_partkey, x, y, round(least(CASE WHEN x < 2 THEN (x + 1) / 3.0 ELSE 1.0 END, CASE WHEN x >= w - 2 THEN (w - x) / 3.0 ELSE 1.0 END) * least(CASE WHEN y < 1 THEN (y + 1) / 2.0 ELSE 1.0 END, 1.0), 6)::DOUBLE AS weight
FROM (SELECT p_partkey, w, x, unnest(range(4)) AS y FROM (SELECT p_partkey, p_size AS w, unnest(range(p_size)) AS x FROM part))""")
def product_masks(t: Tables) -> DataFrame:
    """A two-axis blend mask as the product of both axes' weights."""
    rows = t.part.select("p_partkey", F.col("p_size").alias("w"), F.explode(T.indices(F.col("p_size"))).alias("x")).withColumn("y", F.explode(T.indices(4)))
    weight = T.trapezoid(F.col("x"), F.col("w"), F.lit(2), F.lit(2)) * T.trapezoid(F.col("y"), F.lit(4), F.lit(1), F.lit(0))
    return rows.select("p_partkey", "x", "y", F.round(weight, 6).alias("weight"))


@query("""SELECT vec_id, patch, place, round(x, 6) AS x, r * 8 + c = i AS inverse FROM (SELECT *, (patch // 4) * 2 + place // 2 AS r, (patch % 4) * 2 + place % 2 AS c FROM (
  SELECT vec_id, i, x, (i // 8 // 2) * 4 + (i % 8) // 2 AS patch, (i // 8 % 2) * 2 + i % 8 % 2 AS place FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)))""")
def patchify(t: Tables) -> DataFrame:
    """An 8 x 8 grid as 2 x 2 patches and back."""
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    patch, place = L.patch_of(F.floor(F.col("i") / 8), F.col("i") % 8, 2, F.lit(4))
    rows = rows.select("vec_id", "i", patch.alias("patch"), place.alias("place"), F.round(F.col("x").cast("double"), 6).alias("x"))
    r, c = L.cell_of(F.col("patch"), F.col("place"), 2, F.lit(4))
    return rows.select("vec_id", "patch", "place", "x", (r * 8 + c == F.col("i")).alias("inverse"))


@query("""SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell, round(sum(x) * 1000)::BIGINT AS total, count(*) AS n FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def local_grouping(t: Tables) -> DataFrame:
    """Cells of a fine grid grouped two by two."""
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    cell, _ = L.patch_of(F.floor(F.col("i") / 8), F.col("i") % 8, 2, F.lit(4))
    return rows.groupBy("vec_id", cell.alias("cell")).agg(F.round(F.sum(F.col("x").cast("double")) * 1000).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, i, round(greatest(0, i * 4 - 3) * 0.01, 6)::DOUBLE AS start, round(greatest(0, i * 4 + 1) * 0.01, 6)::DOUBLE AS stop FROM (SELECT p_partkey, unnest(range(p_size)) AS i FROM part)""")
def audio_latent_timings(t: Tables) -> DataFrame:
    """Seconds of each audio latent: hop 160 at 16 kHz, four frames a latent, the first one causal."""
    rows = t.part.select("p_partkey", F.explode(T.indices(F.col("p_size"))).alias("i"))
    start, stop = L.audio_bounds(F.col("i"), 160, 16_000, 4)
    return rows.select("p_partkey", "i", F.round(start, 6).alias("start"), F.round(stop, 6).alias("stop"))


@query("""SELECT p_partkey, step, round(CASE WHEN step = n THEN 0.0 WHEN step = 0 THEN 1.0 WHEN step <= n // 2 THEN 1 - step * 0.025 / (n // 2) ELSE 1 - (step * 0.025 / (n // 2) + ((n // 2) - 0.025 * n) / ((n // 2) * (n - n // 2) * (n - n // 2)) * (step - n // 2) * (step - n // 2)) END, 8)::DOUBLE AS sigma
FROM (SELECT p_partkey, n, unnest(range(n + 1)) AS step FROM (SELECT p_partkey, p_size AS n FROM part))""")
def linear_quadratic_schedule(t: Tables) -> DataFrame:
    """Schedules of as many steps as a part is large, linear first and then quadratic."""
    rows = t.part.select("p_partkey", F.col("p_size").alias("n")).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return rows.select("p_partkey", "step", F.round(L.linear_quadratic(F.col("step"), F.col("n")), 8).alias("sigma"))


@query("""SELECT vec_id, len(r) AS n, round(list_sum(r), 5) AS total FROM (SELECT vec_id, CASE WHEN vec_id % 90 <= 64 THEN e[1:(vec_id % 90)] ELSE list_concat(e, list_transform(range(vec_id % 90 - 64), lambda i: 0.0::DOUBLE)) END AS r FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)) WHERE len(r) > 0""")
def trim_or_pad(t: Tables) -> DataFrame:
    """Tracks cut or zero-filled to a wanted length."""
    rows = t.embeddings.select("vec_id", L.trimmed(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 90).cast("int")).alias("r")).where("size(r) > 0")
    return rows.select("vec_id", F.size("r").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""SELECT p_partkey, i, round(round_even(i * (p_size - 1) / 4.0, 0) / greatest(1, p_size - 1), 6)::DOUBLE AS at FROM (SELECT p_partkey, p_size, unnest(range(5)) AS i FROM part)""")
def anchor_timestamps(t: Tables) -> DataFrame:
    """Anchors as shares of the clip."""
    rows = t.part.select("p_partkey", "p_size", F.posexplode(T.uniform_indices(F.col("p_size"), 5)).alias("i", "x"))
    return rows.select("p_partkey", "i", F.round(F.col("x") / F.greatest(F.lit(1), F.col("p_size") - 1), 6).alias("at"))


@query("""WITH c AS (SELECT conv_id, turn AS p, role <> 'system' AS ok, role = 'assistant' AND role <> 'system' AS img FROM conversations), r AS (SELECT *, p - row_number() OVER (PARTITION BY conv_id, img ORDER BY p) AS run FROM c)
SELECT q.conv_id, q.p AS q, k.p AS k FROM r q JOIN r k USING (conv_id) WHERE q.ok AND k.ok AND (k.p <= q.p OR (q.img AND k.img AND q.run = k.run))""")
def prefix_visibility(t: Tables) -> DataFrame:
    """Causal visibility among valid tokens, full inside each run of image tokens."""
    rows = t.conversations.select("conv_id", "turn", (F.col("role") != "system").alias("valid"), (F.col("role") == "assistant").alias("image"))
    return L.prefix_visibility(rows, "conv_id", "turn", "valid", "image")


@query("""SELECT region, q, (2 * (q // 8) + dr) * 16 + 2 * (q % 8) + dc AS evidence FROM (SELECT r_regionkey AS region, unnest(range(64)) AS q FROM region), (SELECT unnest(range(2)) AS dr), (SELECT unnest(range(2)) AS dc)""")
def local_query_links(t: Tables) -> DataFrame:
    """The four evidence cells that each of a frame's 64 queries sees."""
    return t.region.select(F.col("r_regionkey").alias("region"), F.explode(L.local_links(8)).alias("x")).select("region", F.col("x.query").alias("q"), F.col("x.evidence").alias("evidence"))


@query("SELECT conv_id, turn, 1.0::DOUBLE AS mask FROM conversations WHERE turn < 3")
def truncated_tokens(t: Tables) -> DataFrame:
    """The first three tokens of a state with their mask reset; the attention mask is dropped."""
    state = t.conversations.select("conv_id", "turn", F.lit(0.3).alias("mask"), F.lit(True).alias("attention"))
    return state.where("turn < 3").withColumn("mask", F.lit(1.0)).drop("attention")


@query("""SELECT p_partkey, i AS patch, 0.0::DOUBLE AS latent, 1.0::DOUBLE AS mask, round(greatest(0, i * 8 - 7) / 24.0, 6)::DOUBLE AS start, round(greatest(0, i * 8 + 1) / 24.0, 6)::DOUBLE AS stop FROM (SELECT p_partkey, unnest(range(1 + (p_size - 1) // 8)) AS i FROM part)""")
def initial_state(t: Tables) -> DataFrame:
    """Zero latents under a full mask with causal time bounds in seconds."""
    rows = t.part.select("p_partkey", F.explode(T.indices(T.latent_frames(F.col("p_size")).cast("int"))).alias("patch"))
    start, stop = T.patch_bounds(F.col("patch"), 8, causal=True)
    return rows.select("p_partkey", "patch", F.lit(0.0).alias("latent"), F.lit(1.0).alias("mask"), F.round(start / 24.0, 6).alias("start"), F.round(stop / 24.0, 6).alias("stop"))


@query("""SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE i = 0 OR i % 8 = 1""")
def temporal_subsample(t: Tables) -> DataFrame:
    """A track's first place and every eighth after it."""
    picked = F.transform(T.aligned_subsample(F.size("embedding"), 8), lambda i: F.struct(i.alias("i"), F.get("embedding", i).cast("double").alias("x")))
    return t.embeddings.select("vec_id", F.explode(picked).alias("s")).select("vec_id", "s.i", F.round("s.x", 6).alias("x"))


@query("""SELECT user_id, round(x + (x - d) / 0.8 * (0.5 - 0.8), 6) AS euler, round(x + ((x - d) / 0.8 * 1.5 - (x - d) / 0.8 * 0.5) * (0.5 - 0.8), 6) AS guided, round((x - d) / 0.8, 6) AS velocity FROM (SELECT user_id, avg(value) AS x, min(value) AS d FROM events GROUP BY 1)""")
def step_recurrence(t: Tables) -> DataFrame:
    """An Euler step and one that mixes two velocities, from noise level 0.8 to 0.5."""
    rows = t.events.groupBy("user_id").agg(F.avg("value").alias("x"), F.min("value").alias("d"))
    x, d, v = F.col("x"), F.col("d"), N.velocity(F.col("x"), F.lit(0.8), F.col("d"))
    return rows.select("user_id", F.round(L.euler(x, d, F.lit(0.8), F.lit(0.5)), 6).alias("euler"), F.round(x + (v * 1.5 - v * 0.5) * (0.5 - 0.8), 6).alias("guided"), F.round(v, 6).alias("velocity"))


@query("""SELECT conv_id, turn, round(latent, 4) AS latent, round(mask, 4) AS mask FROM (SELECT conv_id, turn, turn * 1.5 AS latent, 1.0 AS mask FROM conversations WHERE role <> 'system' UNION ALL
SELECT a.conv_id, a.turn + coalesce(n, 0), 0.0, 0.6 FROM conversations a LEFT JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations WHERE role <> 'system' GROUP BY 1) USING (conv_id) WHERE role = 'system')""")
def appended_tokens(t: Tables) -> DataFrame:
    """Condition tokens behind the last of a state, with a weakened mask."""
    state = t.conversations.where("role <> 'system'").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), (F.col("turn") * 1.5).alias("latent"), F.lit(1.0).alias("mask"))
    more = t.conversations.where("role = 'system'").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"))
    return K.append_tokens(state, more, 0.4).select(F.col("batch").alias("conv_id"), F.col("pos").alias("turn"), F.round("latent", 4).alias("latent"), F.round("mask", 4).alias("mask"))


@query("""SELECT p_partkey, CASE WHEN 8 > p_size THEN 1 ELSE 8 END AS tiles, least(3, p_size - CASE WHEN 8 > p_size THEN 1 ELSE 8 END) AS overlap, 12 * p_size // p_size AS scale FROM part""")
def tile_clamp_scale(t: Tables) -> DataFrame:
    """Tiles that fit an extent, and the whole scale between two sizes."""
    tiles, overlap = K.clamp_tiles(F.col("p_size"), F.lit(8), F.lit(3))
    return t.part.select("p_partkey", tiles.alias("tiles"), overlap.alias("overlap"), K.integer_scale(F.col("p_size") * 12, F.col("p_size")).alias("scale"))


@query("""SELECT doc_id, n_chars > 0 AND n_chars % 5 > 0 AS done, array_to_string(list_transform(range(4), lambda i: round_even(i * (n_chars % 30) / 3.0, 0)::INT), ',') AS picks FROM documents""")
def completeness_and_picks(t: Tables) -> DataFrame:
    """Whether all of a record's artefacts are there and not empty; four contact-sheet frames."""
    files = F.array(F.struct((F.col("n_chars") % 5).alias("size")), F.struct(F.col("n_chars").alias("size")))
    picks = K.contact_picks((F.col("n_chars") % 30 + 1).cast("int"), 4)
    return t.documents.select("doc_id", K.complete(files).alias("done"), F.array_join(picks.cast("array<string>"), ",").alias("picks"))


@query("""SELECT vec_id, round(e[1], 6) AS a, round(e[64], 6) AS b, round(e[CASE WHEN vec_id % 80 < 64 THEN vec_id % 80 + 1 ELSE 64 END], 6) AS c FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def gather_and_forward_pad(t: Tables) -> DataFrame:
    """Elements by an index list, of a track padded with its last element."""
    padded = A.forward_pad(F.col("embedding").cast("array<double>"), F.lit(80))
    got = A.gather(padded, F.array(F.lit(0), F.lit(79), (F.col("vec_id") % 80).cast("int")))
    return t.embeddings.select("vec_id", *[F.round(F.get(got, i), 6).alias(n) for i, n in enumerate("abc")])


@query("""SELECT p_partkey, round(0.3 * s + 0.9 * (1 - s), 6)::DOUBLE AS mixed, round(0.95 + (p_size - 1) * 1.1 / 49, 6)::DOUBLE AS shift, round((exp(s) - 1) / s, 6) AS phi1, round(((exp(s) - 1) / s - 1) / s, 6) AS phi2, round(least(0.5, sqrt(0.25 * (s * s - 0.25) / (s * s))), 6) AS up
FROM (SELECT p_partkey, p_size, 0.6 + p_size / 100.0 AS s FROM part)""")
def step_coefficients(t: Tables) -> DataFrame:
    """Masked mix, linear shift, phi functions and the noise of an ancestral step."""
    s = 0.6 + F.col("p_size") / 100.0
    _, up = N.ancestral(s, F.lit(0.5), 1.0)
    return t.part.select("p_partkey", F.round(N.lerp_masked(F.lit(0.3), F.lit(0.9), s), 6).alias("mixed"), F.round(N.linear_shift(F.col("p_size"), (1, 0.95), (50, 2.05)), 6).alias("shift"), F.round(N.phi(1, s), 6).alias("phi1"), F.round(N.phi(2, s), 6).alias("phi2"), F.round(up, 6).alias("up"))


@query("""SELECT user_id, round(sum(0.7 * b * a) + sum(0.3 * a), 4) AS delta FROM (SELECT user_id, value AS a, event_id % 3 AS b FROM events) GROUP BY 1""")
def weighted_products(t: Tables) -> DataFrame:
    """Weighted products of two low-rank parts, summed by key."""
    a, b = F.col("value"), F.col("event_id") % 3
    return t.events.groupBy("user_id").agg(F.round(F.sum(0.7 * b * a) + F.sum(0.3 * a), 4).alias("delta"))
