"""Token-sequence state: visibility, masks, replacement, losses and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def causal_local(query: Column, key: Column, width: int) -> Column:
    return (key <= query) & (query - key < width)


def visibility(tokens: DataFrame, batch: str, pos: str, valid: str, image: str, width: int) -> DataFrame:
    """Pairs of one sequence's tokens with full (causal or same image run, both valid) and
    sliding (that, and local or both of an image within the width) visibility."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(batch, image).orderBy(pos))
    rows = tokens.select(batch, F.col(pos).alias("p"), F.col(valid).alias("ok"), F.col(image).alias("img"), run.alias("run"))
    left = rows.select(batch, *[F.col(c).alias(f"q_{c}") for c in ("p", "ok", "img", "run")])
    right = rows.select(batch, *[F.col(c).alias(f"k_{c}") for c in ("p", "ok", "img", "run")])
    q, k = F.col("q_p"), F.col("k_p")
    both_ok = F.col("q_ok") & F.col("k_ok")
    same_run = F.col("q_img") & F.col("k_img") & (F.col("q_run") == F.col("k_run"))
    full = both_ok & ((k <= q) | same_run)
    near = F.abs(q - k) < width
    return left.join(right, batch).select(batch, "q_p", "k_p", full.alias("full"), (full & (causal_local(q, k, width) | (F.col("q_img") & F.col("k_img") & near))).alias("sliding"))


def replace_range(value: Column, pos: Column, start: int, stop: int, new: Column) -> Column:
    return F.when((pos >= start) & (pos < stop), new).otherwise(value)


def append_tokens(state: DataFrame, more: DataFrame, strength: float) -> DataFrame:
    """Tokens after the last of a state, with zero latents and mask 1 - strength."""
    last = state.groupBy("batch").agg((F.max("pos") + 1).alias("_next"))
    shifted = more.join(last, "batch", "left").select("batch", (F.col("pos") + F.coalesce("_next", F.lit(0))).alias("pos"), F.lit(0.0).alias("latent"), F.lit(1.0 - strength).alias("mask"))
    return state.select("batch", "pos", "latent", "mask").unionByName(shifted)


def conditioned(gate: Column, mask: Column, clean: Column, noisy: Column, t: Column) -> tuple[Column, Column, Column]:
    """(input, timestep, counts in the loss) of a token under a condition mask that a gate turns on."""
    m = F.when(gate, mask).otherwise(0.0)
    return m * clean + (1 - m) * noisy, (1 - m) * t, m == 0


def masked_mse(error: Column, weight: Column) -> Column:
    """Aggregate: weighted squares over the weights' sum, one at least."""
    return F.sum(weight * error * error) / F.greatest(F.sum(weight), F.lit(1.0))


def masked_mse_by_mean(error: Column, mask: Column) -> Column:
    """Aggregate: the mean of masked squares over the mean of the mask."""
    return F.avg(mask * error * error) / F.greatest(F.avg(mask), F.lit(1e-8))


def integer_scale(large: Column, small: Column) -> Column:
    """How often small fits large; an error if it doesn't divide."""
    checked = F.when((small > 0) & (large % small == 0), F.floor(large / small))
    return F.coalesce(checked, F.raise_error(F.lit("sizes don't divide")).cast("long"))


def clamp_tiles(dim: Column, tiles: Column, overlap: Column) -> tuple[Column, Column]:
    """Tiles and overlap that fit an extent: more tiles than the extent become one."""
    n = F.when(tiles > dim, F.lit(1)).otherwise(tiles)
    return n, F.least(overlap, dim - n)


def retained(checkpoints: DataFrame, path: str, keep: int, loaded: str | None = None) -> DataFrame:
    """Checkpoints to keep: one path per step (the loaded one first), the last ``keep`` steps,
    and the loaded one in any case."""
    step = F.regexp_extract(path, r"(\d+)[^\d]*$", 1).try_cast("long")
    rows = checkpoints.withColumn("step", F.coalesce(step, F.lit(-1)))
    mine = F.col(path) == F.lit(loaded) if loaded else F.lit(False)
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("step").orderBy(mine.desc(), F.col(path)))).where("_r = 1")
    one = one.drop("_r")
    return one.orderBy(F.desc("step")).limit(keep).unionByName(one.where(mine)).dropDuplicates([path])


def complete(artifacts: Column) -> Column:
    """Whether a list of (path, size) is non-empty and no file is empty."""
    return F.coalesce((F.size(artifacts) > 0) & F.forall(artifacts, lambda a: a["size"] > 0), F.lit(False))


def contact_picks(n: Column, k: int) -> Column:
    """Indices of k evenly spaced frames, ends included, half to even."""
    from sluice.operators.temporal import uniform_indices

    return uniform_indices(n, k)


def collate(rows: DataFrame, batch: str, order: str, value: str, filler: Column) -> DataFrame:
    """Lists of a batch in order, padded to the longest list."""
    longest = rows.groupBy(batch).agg(F.max(F.size(value)).alias("_m"))
    padded = F.concat(F.col(value), F.array_repeat(filler, F.col("_m") - F.size(value)))
    met = rows.join(longest, batch).select(batch, order, padded.alias(value))
    return met.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_x")).select(batch, F.col(f"_x.{value}").alias(value))


def collated(rows: DataFrame, batch: str, order: list[str], fields: list[str], task: str = "task", shape: str = "shape", error: str = "error") -> DataFrame:
    """Microbatches as lists by field, in ``order``, a row each: batch, n, errors, the fields' lists, problem.

    A batch with samples that failed to load holds their errors only (its lists are null); else samples of several tasks or shapes
    are a problem, and the batch has no lists either. Batches are of a microbatch's size, so a list is one, too."""
    picked = F.struct(*order, *[F.col(f).alias(f"_v{i}") for i, f in enumerate(fields)], F.col(error).alias("_e"))
    kinds = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
    got = rows.groupBy(batch).agg(F.array_sort(F.collect_list(picked)).alias("_s"), kinds(task).alias("_tasks"), kinds(shape).alias("_shapes"))
    errors = F.filter(F.col("_s._e"), lambda e: e.isNotNull())
    problem = F.when(F.size(errors) > 0, None).when(F.col("_tasks"), "mixed_tasks").when(F.col("_shapes"), "mixed_shapes")
    whole = (F.size(errors) == 0) & problem.isNull()
    return got.select(batch, F.size("_s").alias("n"), errors.alias("errors"), *[F.when(whole, F.col(f"_s._v{i}")).alias(f) for i, f in enumerate(fields)], problem.alias("problem"))
