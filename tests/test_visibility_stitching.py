"""Visibility as ranges against pairs, and tiles that come back as they were."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import stitching as S
from sluice.operators import visibility as V


def lists(spark, rows):
    kind = "array<struct<start:bigint,end:bigint>>"
    return spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")


def cells(ranges):
    return {k for a, b in ranges for k in range(a, b)}


def test_algebra_of_range_lists(spark):
    rng = random.Random(3)
    make = lambda: [(a := rng.randrange(30), a + rng.randrange(-2, 8)) for _ in range(rng.randrange(5))]
    rows = [(i, make(), make()) for i in range(60)]
    df = lists(spark, rows)
    got = df.select("i", V.union(F.col("a"), F.col("b")).alias("u"), V.intersection(F.col("a"), F.col("b")).alias("c"), V.visible(V.merged(F.col("a"))).alias("n")).collect()
    for r in got:
        _, a, b = rows[r.i]
        for name, want in (("u", cells(a) | cells(b)), ("c", cells(a) & cells(b))):
            found = [tuple(x) for x in r[name]]
            assert cells(found) == want and all(x[1] < y[0] for x, y in zip(found, found[1:])), (a, b, found)
        assert r.n == len(cells(a))


def sequences(seed=1):
    rng = random.Random(seed)
    rows = []
    for b in range(6):
        for p in range(rng.randrange(1, 25)):
            image = rng.random() < 0.5
            rows.append((b, p, rng.random() < 0.8, image))
    return rows


def rules(rows, width=None):
    """Pairs of valid tokens by position: causal, or in one run of valid image tokens; within ``width`` if there is one."""
    out = set()
    for b in {r[0] for r in rows}:
        seq = {p: (ok, img) for x, p, ok, img in rows if x == b}
        run, name = {}, 0
        for p in sorted(seq):
            if not (seq[p][0] and seq[p][1] and run.get(p - 1) is not None):
                name += 1
            run[p] = name if seq[p][0] and seq[p][1] else None
        for q, (ok, _) in seq.items():
            for k, (fine, _) in seq.items():
                if ok and fine and (k <= q or (run[q] is not None and run[q] == run[k])) and (width is None or abs(q - k) < width):
                    out.add((b, q, k))
    return out


@pytest.mark.parametrize("width", [None, 1, 3, 50])
def test_prefix_and_sliding_visibility(spark, width):
    rows = sequences()
    df = spark.createDataFrame(rows, "b int, p int, ok boolean, img boolean")
    got = V.prefix_ranges(df, "b", "p", "ok", "img") if width is None else V.sliding_ranges(df, "b", "p", "ok", "img", width)
    place = {}
    for b in range(6):
        for n, p in enumerate(sorted(p for x, p, ok, _ in rows if x == b and ok)):
            place[b, n] = p
    assert {(r.b, r.p, place[r.b, r.k]) for r in V.pairs(got, "b", "p").collect()} == rules(rows, width)
    assert got.where(F.size("ranges") > 1).count() == 0


def test_teacher_visibility(spark):
    rows = [r for r in sequences(2) if r[0] < 3]
    df = spark.createDataFrame(rows, "b int, p int, ok boolean, img boolean")
    frames = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (9, 1)], "b int, frames int")
    got = V.teacher_ranges(df, frames, "b", "p", "ok", "img")
    assert got.where(F.size("ranges") > 4).count() == 0
    pairs = {(r.b, r.n, r.k) for r in V.pairs(got, "b", "n").collect()}
    want = set()
    for b, count in ((0, 2), (1, 0), (2, 1), (9, 1)):
        valid = sorted(p for x, p, ok, _ in rows if x == b and ok)
        at = {p: n for n, p in enumerate(valid)}
        want |= {(b, at[q], at[k]) for x, q, k in rules(rows) if x == b}
        for f in range(count):
            first = len(valid) + f * 320
            for e in range(256):
                want |= {(b, first + e, k) for k in [*range(len(valid)), *range(first, first + 256)]}
            for q in range(64):
                r, c = q // 8, q % 8
                near = [first + (2 * r + i) * 16 + 2 * c + j for i in (0, 1) for j in (0, 1)]
                want |= {(b, first + 256 + q, k) for k in [*range(len(valid)), *near, first + 256 + q]}
    assert pairs == want


@pytest.mark.parametrize("tile,overlap", [(5, 0), (5, 2), (6, 3), (7, 1), (50, 10)])
def test_tiles_come_back(spark, tile, overlap):
    rng = random.Random(tile)
    signals = {i: [rng.uniform(-1, 1) for _ in range(n)] for i, n in enumerate([1, 4, 5, 6, 9, 23, 40])}
    df = spark.createDataFrame([(i, v) for i, v in signals.items()], "id int, v array<double>")
    tiles = df.select("id", F.explode(S.tile_bounds(F.size("v"), tile, overlap)).alias("t"), "v").select("id", "t.*", F.slice("v", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")).alias("x"))
    got = S.stitched(tiles, ["id"], "x").collect()
    assert len(got) == sum(map(len, signals.values()))
    for r in got:
        assert r.value == pytest.approx(signals[r.id][r.cell], abs=1e-6)
        assert r.total == pytest.approx(1.0) if overlap * 2 <= tile else r.total > 0
    with pytest.raises(ValueError):
        S.tile_bounds(F.lit(3), 2, 2)


def test_uneven_neighbours_share_their_own_overlap(spark):
    tiles = spark.createDataFrame([(0, 4, [1.0] * 4), (2, 9, [3.0] * 7), (8, 12, [5.0] * 4)], "start int, end int, x array<double>").withColumn("id", F.lit(1))
    got = {r.cell: (round(r.value, 6), round(r.total, 9)) for r in S.stitched(tiles, ["id"], "x").collect()}
    assert all(t == 1.0 for _, t in got.values()) and len(got) == 12
    assert got[0][0] == 1.0 and got[5][0] == 3.0 and got[11][0] == 5.0 and got[2][0] == pytest.approx(1 + 2 / 3) and got[3][0] == pytest.approx(1 + 4 / 3) and got[8][0] == pytest.approx(4.0)
