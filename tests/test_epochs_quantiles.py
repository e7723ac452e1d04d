"""Epochs by slot, and quantile functions, against plain versions."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from sluice.functions import quantiles
from sluice.operators.epochs import epoch_slots, shuffled


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_a_permutation_for_every_key(spark, n):
    rows = spark.range(n).select("id", *[shuffled(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(k)).alias(f"k{k}") for k in range(3)]).collect()
    for k in range(3):
        assert sorted(r[f"k{k}"] for r in rows) == list(range(n))
    if n == 1000:
        assert len({tuple(r[f"k{k}"] for r in rows) for k in range(3)}) == 3
        assert abs(statistics.correlation([r.id for r in rows], [r.k0 for r in rows])) < 0.1


@pytest.mark.parametrize("block", [1, 7, 16])
def test_epochs_are_exact_and_blocks_unique(spark, block):
    sizes = {"a": 100, "b": 37, "c": 33, "d": 32, "e": 16, "f": 20, "g": 5, "h": 1, "i": 96, "none": 0}
    steps = 60
    df = spark.createDataFrame([(t, n, steps if t != "i" else 0) for t, n in sizes.items()], "task string, size int, steps int")
    got = epoch_slots(df, block, "seed").toPandas()
    assert sorted(got.task.unique()) == sorted(t for t, n in sizes.items() if n and t != "i")
    for task, part in got.groupby("task"):
        n = sizes[task]
        part = part.sort_values(["step", "slot"])
        assert len(part) == steps * block and part.step.max() == steps - 1 and part.slot.max() == block - 1
        order = part.row_index.tolist()
        for at in range(0, len(order) - n + 1, n):
            assert sorted(order[at : at + n]) == list(range(n))
        if n >= block:
            assert not part.duplicated(["step", "row_index"]).any(), task
        if n >= 2 * block and n > 4 and len(order) >= 3 * n:
            assert order[:n] != order[n : 2 * n]


def test_no_shuffle_moves_slots(spark):
    df = spark.createDataFrame([("a", 1_000_000, 10**6)], "task string, size long, steps long")
    plan = epoch_slots(df, 100, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")  # chunks are dealt before slots are made
    some = epoch_slots(spark.createDataFrame([("a", 10**9, 40)], "task string, size long, steps long"), 100, "s")
    assert some.select("row_index").distinct().count() == 4000


def test_normal_quantiles(spark):
    shares = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.9999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0, -0.1, 1.1]], "p double").select("p", quantiles.normal_quantile(F.col("p")).alias("x")).collect()
    for r in rows[: len(shares)]:
        assert r.x == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)
    assert [r.x for r in rows[len(shares) :]] == [-math.inf, math.inf, None, None]


def share_below(x, a, b, n=200_000):
    """By the midpoint rule, in u = t^a where t^(a - 1) has a pole, on the left half and its mirror on the right."""
    def part(y, a, b):
        if a >= 1:
            return sum((t := (i + 0.5) * y / n) ** (a - 1) * (1 - t) ** (b - 1) for i in range(n)) * y / n
        top = y**a
        return sum((1 - ((i + 0.5) * top / n) ** (1 / a)) ** (b - 1) for i in range(n)) * top / n / a

    whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    return part(x, a, b) / whole if x <= 0.5 else 1 - part(1 - x, b, a) / whole


@pytest.mark.parametrize("a,b", [(0.6, 0.6), (2.0, 5.0), (0.5, 3.0), (20.0, 30.0)])
def test_beta_quantiles(spark, a, b):
    shares = [0.001, 0.05, 0.25, 0.5, 0.8, 0.99, 0.9999]
    rows = spark.createDataFrame([(p,) for p in shares], "p double").select("p", quantiles.beta_quantile(F.col("p"), a, b).alias("x")).collect()
    for r in rows:
        assert share_below(r.x, a, b) == pytest.approx(r.p, abs=1e-6)
    ends = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "p double").select(quantiles.beta_quantile(F.col("p"), a, b)).collect()
    assert [r[0] for r in ends] == [0.0, 1.0, None]


def test_known_beta_quantiles(spark):
    """beta(1/2, 1/2) is the arcsine law, beta(1, b) and beta(a, 1) are powers."""
    rows = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    got = rows.select("p", *[quantiles.beta_quantile(F.col("p"), a, b).alias(n) for n, a, b in (("arc", 0.5, 0.5), ("one", 1.0, 4.0), ("two", 3.0, 1.0))]).collect()
    for r in got:
        assert r.arc == pytest.approx(math.sin(math.pi * r.p / 2) ** 2, abs=1e-9)
        assert r.one == pytest.approx(1 - (1 - r.p) ** 0.25, abs=1e-9) and r.two == pytest.approx(r.p ** (1 / 3), abs=1e-9)


def test_beta_sigmas_fall_to_zero_without_repeats(spark):
    for r in spark.createDataFrame([(1,), (8,), (40,)], "n int").select("n", quantiles.beta_sigmas(F.col("n")).alias("s")).collect():
        assert r.s[0] == 1.0 and r.s[-1] == 0.0 and all(x > y for x, y in zip(r.s, r.s[1:])) and len(r.s) <= r.n + 1


def test_draws_have_their_moments(spark):
    u = lambda k: F.xxhash64(F.lit(k), "id").cast("double") / 2.0**64 + 0.5
    rows = spark.range(40_000).select(u("a").alias("u"), u("b").alias("o"), u("c").alias("w"))
    draw = lambda share: quantiles.logit_normal_draw(F.col("u"), F.col("o"), F.col("w"), F.lit(1.2), uniform_share=share)
    got = rows.select(draw(0.0).alias("x"), draw(1.0).alias("y"), draw(0.1).alias("z")).agg(F.mean("x"), F.min("x"), F.max("x"), F.mean("y"), F.mean("z")).first()
    normal, n = statistics.NormalDist(), 20_000
    sig = lambda x: 1 / (1 + math.exp(-x))
    low, high = sig(1.2 - 2.5758), sig(1.2 + 3.0902)
    raw = [(sig(normal.inv_cdf((i + 0.5) / n) + 1.2) - low) / (high - low) for i in range(n)]
    mean = statistics.fmean(min(1.0, max(0.0, x if x >= 1e-3 else 2e-3 - x)) for x in raw)
    assert got[0] == pytest.approx(mean, abs=0.005) and 0 <= got[1] and got[2] <= 1
    assert got[3] == pytest.approx(0.5005, abs=0.005) and got[4] == pytest.approx(0.9 * mean + 0.05005, abs=0.01)


def test_draws_of_very_long_texts(spark, tmp_path):
    """Both quantiles of the stretch are 1.0 as doubles there; the SQL's quotient is not a number, and its draw is cut to 1."""
    import duckdb

    from sluice import registry

    sizes = [0, 40_000, 100_000, 107_000, 110_000, 122_698, 1_000_000, None]
    spark.createDataFrame([(i, sizes[i % len(sizes)]) for i in range(80)], "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = registry.ORACLE_SQL["logit_normal_draws"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.doc_id: (r.u, r.timestep) for r in registry.QUERIES["logit_normal_draws"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert sum(got[i][1] == 1.0 for i in range(80) if sizes[i % len(sizes)] == 1_000_000) >= 8


def test_linear_quadratic_of_one_step(spark):
    from sluice.operators.latents import linear_quadratic

    rows = spark.createDataFrame([(0, 1), (1, 1), (0, 2), (1, 2), (2, 2), (0, 3), (3, 3)], "i int, n int").select(linear_quadratic(F.col("i"), F.col("n"))).collect()
    assert [r[0] for r in rows] == pytest.approx([1.0, 0.0, 1.0, 0.975, 0.0, 1.0, 0.0])
