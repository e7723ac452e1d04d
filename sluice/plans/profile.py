"""Profiles and summaries of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.catalog import Tables, query


def profile_fields(df: DataFrame, name: str) -> DataFrame:
    """table_name, field, n_rows, n_null, null_fraction: one pass over all columns."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    rows = counted.selectExpr("n_rows", f"stack({len(df.columns)}, {pairs}) as (field, n_null)")
    return rows.select(F.lit(name).alias("table_name"), "field", "n_rows", "n_null", F.round(F.col("n_null") / F.col("n_rows"), 6).alias("null_fraction"))


def _fields_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS field, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_fraction FROM {table}" for c in columns)


@query(_fields_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]) + " UNION ALL " + _fields_sql("labels", ["doc_id", "quality", "toxic"]))
def scan_profile_fields(t: Tables) -> DataFrame:
    return profile_fields(t.documents, "documents").unionAll(profile_fields(t.labels, "labels"))


@query(r"""SELECT lang, count(*) AS n, min(c) AS min_chars, max(c) AS max_chars, round(avg(c), 4) AS mean_chars, median(c)::DOUBLE AS median_chars,
  round(avg(w), 4) AS mean_words, median(w)::DOUBLE AS median_words
FROM (SELECT lang, length(text) AS c, len(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY lang""")
def summary_stats_text(t: Tables) -> DataFrame:
    """Exact counts, extremes, means and medians of characters and words."""
    rows = t.documents.select("lang", F.length("text").cast("long").alias("c"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("w"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("min_chars"), F.max("c").alias("max_chars"), F.round(F.avg("c"), 4).alias("mean_chars"), F.median("c").alias("median_chars"), F.round(F.avg("w"), 4).alias("mean_words"), F.median("w").alias("median_words"))


@query("""SELECT floor(100 * p_size / 7)::BIGINT AS aspect, p_type, count(*) AS n FROM part GROUP BY ALL""")
def aspect_distribution(t: Tables) -> DataFrame:
    return t.part.groupBy(F.floor(100 * F.col("p_size") / 7).alias("aspect"), "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS label FROM part) GROUP BY label""")
def label_explode_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_type", " ")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT items, count(*) AS n, min(o) AS first_order FROM (SELECT l_orderkey AS o, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS items FROM lineitem GROUP BY 1)
GROUP BY items HAVING count(*) > 1""")
def duplicate_lists(t: Tables) -> DataFrame:
    """Lists that several orders share."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_suppkey")), ",").alias("items"))
    return lists.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order")).where("n > 1")


@query("""SELECT greatest(0, least(9, floor((value - lo) / ((hi - lo) / 10))))::INT AS bucket, count(*) AS n, round(avg(value), 4) AS mean_value
FROM events, (SELECT 0.0 AS lo, 100.0 AS hi) WHERE value IS NOT NULL GROUP BY 1""")
def bucket_mean(t: Tables) -> DataFrame:
    """Means per bucket of ten over [0, 100]; values beyond the ends fall into the end buckets."""
    bucket = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.col("value") / 10.0))).cast("int")
    return t.events.where("value is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""SELECT floor(f / 8)::BIGINT AS g, cell, max(m) > 50 AS on_, round(max(m), 4) AS top FROM (
  SELECT user_id % 16 AS cell, hour(ts) AS f, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def grid_avg_then_max_pool(t: Tables) -> DataFrame:
    """Average per cell and frame, then the maximum over groups of eight frames."""
    cells = t.events.groupBy((F.col("user_id") % 16).alias("cell"), F.hour("ts").alias("f")).agg(F.avg("value").alias("m"))
    return cells.groupBy(F.floor(F.col("f") / 8).alias("g"), "cell").agg((F.max("m") > 50).alias("on_"), F.round(F.max("m"), 4).alias("top"))


@query("""SELECT l_partkey, round(sum(l_discount * l_extendedprice) / (sum(l_discount) + 1e-8), 4) AS blended FROM lineitem GROUP BY l_partkey""")
def weighted_blend(t: Tables) -> DataFrame:
    w = F.col("l_discount")
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.sum(w * F.col("l_extendedprice")) / (F.sum(w) + 1e-8), 4).alias("blended"))


@query("""SELECT l_suppkey, round(sum(x * w), 4) AS accumulated FROM (
  SELECT l_suppkey, l_extendedprice AS x, 1.0 / count(*) OVER (PARTITION BY l_partkey) AS w FROM lineitem) GROUP BY l_suppkey""")
def shared_token_blend(t: Tables) -> DataFrame:
    """Contributions weighted by one over the number of keepers of a shared part."""
    keepers = t.lineitem.groupBy("l_partkey").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return t.lineitem.join(keepers, "l_partkey").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("w")), 4).alias("accumulated"))


@query("""SELECT o_orderstatus, string_agg(s || '=' || n, ',' ORDER BY s) AS nested FROM (
  SELECT o_orderstatus, o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def nested_counts(t: Tables) -> DataFrame:
    """A two-level count: status -> priority -> n, keys in order."""
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.col("o_orderpriority").alias("s"), F.col("n"))
    listed = counts.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return listed.select("o_orderstatus", F.array_join(F.transform("x", lambda p: F.concat_ws("=", p.s, p.n.cast("string"))), ",").alias("nested"))


@query("""SELECT p_brand, count(*) FILTER (p_size < 10) AS n_small, count(*) FILTER (p_retailprice > 1500) AS n_costly, bool_and(p_size > 0) AS all_positive FROM part GROUP BY p_brand""")
def risk_flag_sums(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count_if(F.col("p_size") < 10).alias("n_small"), F.count_if(F.col("p_retailprice") > 1500).alias("n_costly"), F.bool_and(F.col("p_size") > 0).alias("all_positive"))


@query("""SELECT n_refs, count(*) AS n FROM (SELECT l_orderkey, least(count(*), 7) AS n_refs FROM lineitem GROUP BY l_orderkey) GROUP BY n_refs ORDER BY n_refs""")
def reference_count_histogram(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.least(F.count(F.lit(1)), F.lit(7)).alias("n_refs"))
    return per.groupBy("n_refs").agg(F.count(F.lit(1)).alias("n")).orderBy("n_refs")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Shard counters merged: sums, and the maximum of cache counters."""
    return reduce(DataFrame.unionByName, parts).groupBy("task").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_rejected").alias("n_rejected"), F.max("cache_hits").alias("cache_hits"))


@query("""SELECT lang AS task, sum(n)::BIGINT AS n_rows, sum(bad)::BIGINT AS n_rejected, max(hits) AS cache_hits FROM (
  SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 8000) AS bad, count(DISTINCT text) AS hits FROM documents GROUP BY 1, 2) GROUP BY 1""")
def shard_counter_merge(t: Tables) -> DataFrame:
    shards = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_chars") > 8000).alias("n_rejected"), F.count_distinct("text").alias("cache_hits"))
    return merged([shards.withColumnRenamed("lang", "task").drop("source")])
