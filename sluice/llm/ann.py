"""Nearest neighbours by multiprobe p-stable hashing.

Every table has ``WIDTH_K`` Gaussian projections cut into cells of width ``CELL`` times the
data's scale: the ``SCALE_SHARE`` quantile of distances from the mean, over all vectors of one length. A query
looks into its own bucket and into ``PROBES`` buckets with perturbed cells, in the order
of their estimated success: the sum of squared distances to the cell borders that are
crossed, smallest first, from a heap of shift and expand moves. Candidates of all tables are
ranked by exact Euclidean distance in double precision on the original vectors.

Queries for which the probed buckets hold fewer than k rows, and those that lie more than ``FAR`` scales
from the mean, are compared with all vectors of their length, block by block.

Equal vectors are indexed once, with their k + 1 smallest ids (a window limit that Spark
applies before its shuffle), so a vector that a third of all rows share is one entry.
Buckets of more than ``SPLIT`` entries are parted by a hash of the id, and their
queries go to every part. A bucket's part gives the k + 1 nearest for each query only.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; distances are defined between vectors of one length; fewer
vectors than k of a length give fewer rows; ties go to the smaller id; rows with a null id take no part;
of repeated ids each row counts: each query row gets a list of its own (so a repeated query id has several), and only
one row that is as the query's own is left out of it; an empty table gives no rows; columns other than the id and the vector are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.store import keep, slots, table
from sluice.operators.identity import with_row_index

TABLES = 4
WIDTH_K = 6
CELL = 2.0
SCALE_SHARE = 0.9
FAR = 2.0
PROBES = 48
SPLIT = 50_000
SEED = 20_240


def hash_table(number: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, number, dim])
    return rng.normal(size=(dim, WIDTH_K)), rng.uniform(0, CELL, WIDTH_K)


def cells(vectors: np.ndarray, number: int) -> np.ndarray:
    """Places of vectors in a table, in cell widths."""
    a, b = hash_table(number, vectors.shape[1])
    return (vectors @ a + b) / CELL


def bucket_ids(places: np.ndarray, number: int, dim: int) -> np.ndarray:
    """One long for each row of cell numbers."""
    h = np.full(len(places), np.uint64(number * 0x9E3779B97F4A7C15 + dim & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in places.astype(np.int64).T:
            h = (h ^ column.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def perturbations(inside: np.ndarray, most: int) -> list[np.ndarray]:
    """Steps to the own and ``most`` further buckets, likeliest first. inside: the
    place within each cell, 0 to 1."""
    k = len(inside)
    cost = np.concatenate([inside**2, (1 - inside) ** 2])
    order = np.argsort(cost, kind="stable")
    out = [np.zeros(k, dtype=np.int64)]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[order[0]]), (0,))]
    while heap and len(out) <= most:
        total, chosen = heapq.heappop(heap)
        dims = [int(order[i]) % k for i in chosen]
        if len(set(dims)) == len(dims):
            step = np.zeros(k, dtype=np.int64)
            for i in chosen:
                step[order[i] % k] = -1 if order[i] < k else 1
            out.append(step)
        last = chosen[-1]
        if last + 1 < 2 * k:
            here, there = float(cost[order[last]]), float(cost[order[last + 1]])
            heapq.heappush(heap, (total - here + there, chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + there, chosen + (last + 1,)))
    return out


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector in a column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[(first[rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)))
    return out


def centres(entries: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column("v")) if batch.num_rows else []:
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["dim", "n", "total"])

    sums = entries.select("v").mapInArrow(run, "dim int, n long, total array<double>").select("dim", "n", F.posexplode("total").alias("i", "t"))
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("dim", "i").agg((F.sum("t") / F.sum("n")).alias("mean")).collect():  # a row per length and component
        out.setdefault(r.dim, np.zeros(r.dim))[r.i] = r["mean"]
    return out


def _far(centre: dict[int, np.ndarray]):
    """uid, length and distance from the mean of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column("v")) if batch.num_rows else []:
                far = np.linalg.norm(x - centre[x.shape[1]], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(far)], names=["uid", "dim", "far"])

    return run


def _bucketed(batches: Iterator[pa.RecordBatch], probes: int | None, scale: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, vectors in _matrix(batch.column("v")) if batch.num_rows else []:
            for number in range(TABLES):
                at = cells(vectors / scale[vectors.shape[1]], number)
                low = np.floor(at)
                if probes is None:
                    who, where = rows, low
                else:
                    steps = [perturbations(x, probes) for x in at - low]
                    who = np.repeat(rows, [len(s) for s in steps])
                    where = np.concatenate([low[i] + np.array(s) for i, s in enumerate(steps)])
                picked = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(bucket_ids(where, number, vectors.shape[1])), picked.column("uid"), picked.column("v")], names=["bucket", "uid", "v"])


def _search(k: int):
    """Rows sorted by (bucket, part, role): the k nearest entries of each part for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            part = pa.Table.from_batches(held).combine_chunks()
            bucket, piece, role, uid = (part.column(c).to_numpy() for c in ("bucket", "part", "role", "uid"))
            edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(piece) != 0)) + 1
            stop = len(bucket) if last else (int(edge[-1]) if len(edge) else 0)
            vectors = part.column("v").combine_chunks()
            q_out, c_out, d_out = [], [], []
            bounds = [0, *edge[edge < stop].tolist(), stop]
            for a, b in zip(bounds, bounds[1:]):
                n = int((role[a:b] == 0).sum())
                if 0 < n < b - a:
                    by_dim = _matrix(vectors.slice(a, b - a))
                    for at, x in by_dim:
                        asks, gives = at < n, at >= n
                        entries, ids = x[gives], uid[a + at[gives]]
                        if len(ids):
                            for q, v in zip(uid[a + at[asks]], x[asks]):
                                diff = entries - v
                                dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                                near = np.lexsort((ids, dist))[:k]
                                q_out.append(np.full(len(near), q))
                                c_out.append(ids[near])
                                d_out.append(dist[near])
            held = part.slice(stop).to_batches() if stop < len(bucket) else []
            rows = len(bucket) - stop
            if q_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q_out, c_out, d_out)], names=["quid", "uid", "dist"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 20_000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def usable(column: str):
    """Whether a vector takes part."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _of_length(scale: dict[int, float]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in scale.items() for x in pair]), F.col("dim")) if scale else F.lit(1.0)


def _compared(asking: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """Every block of queries beside every block of entries of their length, for ``_search``."""
    sized = lambda df, name: df.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias(name))
    blocks = F.broadcast(keep(sized(asking, "of_q").join(sized(entries, "of_e"), "dim"), "blocks"))  # a row per length
    block = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    asks = asking.withColumn("dim", F.size("v")).join(blocks, "dim").withColumn("e", F.explode(F.sequence(F.lit(0), F.col("of_e") - 1))).withColumn("q", block("of_q"))
    gives = entries.withColumn("dim", F.size("v")).join(blocks, "dim").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("of_q") - 1))).withColumn("e", block("of_e"))
    dealt = [x.select(F.col("dim").cast("long").alias("bucket"), (F.col("e") * F.col("of_q") + F.col("q")).alias("part"), F.lit(role).alias("role"), "uid", "v") for role, x in enumerate((asks, gives))]
    return dealt[0].unionAll(dealt[1]).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "role", "uid")


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row where ``is_query``."""
    n = slots(rows.sparkSession)
    used = rows.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where("id is not null")
    used = used.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    first = Window.partitionBy("h1", "h2").orderBy("id")
    kept = keep(used.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1), "vectors")
    #: entries are numbered in order of their smallest id, so that ties by number are ties by id
    entries = keep(with_row_index(kept.where("r = 1").select("id", "v", "h1", "h2"), ["id", "h1", "h2"], "uid").select("uid", "v", "h1", "h2"), "entries")
    named = entries.select("h1", "h2", "uid")
    ids = kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(named, ["h1", "h2"]).select("uid", "ids")  # k + 1 of each at most
    asked = used.where("asks").select(F.col("id").alias("query_id"), "h1", "h2").join(named.withColumnRenamed("uid", "quid"), ["h1", "h2"])
    asked = keep(asked.select("query_id", "quid", F.monotonically_increasing_id().alias("ask")), "asked")  # a row per query row

    bucketed = "bucket long, uid long, v array<double>"
    asking = keep(entries.join(asked.select(F.col("quid").alias("uid")).distinct(), "uid", "left_semi").select("uid", "v"), "asking")
    centre = centres(entries)
    distances = "uid long, dim int, far double"
    spans = entries.select("uid", "v").mapInArrow(_far(centre), distances).where(~F.isnan("far")).groupBy("dim").agg(F.percentile_approx("far", SCALE_SHARE).alias("span")).collect()  # a row per length
    scale = {dim: 1.0 for dim in centre} | {r.dim: r.span for r in spans if 0 < r.span < float("inf")}
    index = entries.select("uid", "v").mapInArrow(lambda b: _bucketed(b, None, scale), bucketed)
    queries = asking.mapInArrow(lambda b: _bucketed(b, probes, scale), bucketed)
    crowded = keep(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "crowded")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(crowded, "bucket", "left").select("bucket", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), F.lit(1).alias("role"), "uid", "v")
    queries = queries.join(crowded, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), "uid", "v")
    dealt = index.unionAll(queries).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "role", "uid")
    results = "quid long, uid long, dist double"
    found = keep(dealt.mapInArrow(_search(k + 1), results).dropDuplicates(["quid", "uid"]), "found")

    held = found.join(ids.select("uid", F.size("ids").alias("m")), "uid").groupBy(F.col("quid").alias("uid")).agg(F.sum("m").alias("m"))
    outer = asking.mapInArrow(_far(centre), distances).where(F.col("far") > FAR * _of_length(scale))
    short = asking.join(held, "uid", "left").where(F.coalesce("m", F.lit(0)) <= k).select("uid")
    left = keep(asking.join(short.unionAll(outer.select("uid")).distinct(), "uid", "left_semi"), "left")
    found = found.unionAll(_compared(left, entries.select("uid", "v"), n).mapInArrow(_search(k + 1), results)).dropDuplicates(["quid", "uid"])

    by_near = Window.partitionBy("quid").orderBy("dist", "uid")
    top = found.withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= k + 1).drop("r")
    spread = top.join(ids, "uid").select("quid", "uid", "dist", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("quid").orderBy("dist", "vec_id", "uid")
    best = spread.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    #: of rows that are as the query's own one goes, the others are candidates like any row
    own = F.min(F.when((F.col("uid") == F.col("quid")) & (F.col("vec_id") == F.col("query_id")), F.col("r"))).over(Window.partitionBy("ask"))
    out = asked.join(best, "quid").withColumn("own", own).where("own is null or r <> own")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy("r"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("dist").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
