"""Vector queries over embeddings, and ragged lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import arrays as A
from sluice.plans.catalog import Tables, query


@query("""SELECT vec_id, round((m - lo) / (hi - lo + 1e-6), 6) AS normed FROM (
  SELECT vec_id, list_avg(e) AS m, list_min(e) AS lo, list_max(e) AS hi FROM (SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > -0.1), lambda x: x::DOUBLE) AS e FROM embeddings))""")
def masked_range_norm(t: Tables) -> DataFrame:
    """Mean over unmasked places, scaled by their range."""
    kept = F.transform(F.filter("embedding", lambda x: x.cast("double") > F.lit(-0.1).cast("float").cast("double")), lambda x: x.cast("double"))
    rows = t.embeddings.select("vec_id", kept.alias("e"))
    mean = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x) / F.size("e")
    return rows.select("vec_id", F.round((mean - F.array_min("e")) / (F.array_max("e") - F.array_min("e") + 1e-6), 6).alias("normed"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) + 1e-6), 6) AS rms FROM embeddings")
def rms_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(A.rms(F.col("embedding")), 6).alias("rms"))


_PAIR = """SELECT a.vec_id, list_sum(list_transform(range(len(a.embedding)), lambda i: a.embedding[i + 1]::DOUBLE * b.embedding[i + 1]::DOUBLE)) AS ab, list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS bb, list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS aa
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _pairs(t: Tables) -> DataFrame:
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.select("vec_id", "embedding").join(other, "vec_id")


@query(f"SELECT vec_id, round(ab / (bb + 1e-8), 6) AS coefficient FROM ({_PAIR})")
def projection_coef(t: Tables) -> DataFrame:
    return _pairs(t).select("vec_id", F.round(A.projection(F.col("embedding"), F.col("other")), 6).alias("coefficient"))


@query(f"SELECT vec_id, round(1 - ab / (sqrt(aa) * sqrt(bb)), 6) AS distance FROM ({_PAIR})")
def cosine_distance(t: Tables) -> DataFrame:
    return _pairs(t).select("vec_id", F.round(A.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("""SELECT o_custkey, array_to_string(list_concat(k, list_transform(range(m - len(k)), lambda i: 0)), ',') AS padded FROM (
  SELECT o_custkey, k, max(len(k)) OVER (PARTITION BY o_custkey % 10) AS m FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1))""")
def pad_to_batch_max(t: Tables) -> DataFrame:
    """Each customer's orders padded with zeros to the longest list of its batch; a batch's
    longest is a partial maximum joined back."""
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k")).withColumn("b", F.col("o_custkey") % 10)
    longest = lists.groupBy("b").agg(F.max(F.size("k")).alias("m"))
    padded = lists.join(longest, "b").select("o_custkey", A.pad_to(F.col("k"), F.col("m"), F.lit(0).cast("long")).alias("k"))
    return padded.select("o_custkey", F.array_join(padded.k.cast("array<string>"), ",").alias("padded"))


@query("""SELECT label, round(avg(x), 6) AS mean_x, round(stddev_samp(x), 6) AS std_x FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label""")
def channel_statistics(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.explode("embedding").alias("x")).select("label", F.col("x").cast("double").alias("x"))
    return rows.groupBy("label").agg(F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.stddev_samp("x"), 6).alias("std_x"))


@query("SELECT p_partkey, array_to_string(list_concat(list_transform(range((p_size // 8)::BIGINT), lambda i: 8), CASE WHEN p_size % 8 > 0 THEN [p_size % 8] ELSE [] END), ',') AS sizes FROM part")
def batch_split_sizes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(A.split_sizes(F.col("p_size"), 8).cast("array<string>"), ",").alias("sizes"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey DESC)[1:3], ',') AS kept, count(*) AS n FROM orders GROUP BY 1")
def retain_last_n(t: Tables) -> DataFrame:
    """The last three orders of each customer, newest first, and how many there were."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    last = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).where("r <= 3")
    listed = last.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("k"))
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "o_custkey").select("o_custkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("kept"), "n")
