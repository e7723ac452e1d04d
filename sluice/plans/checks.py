"""Validators: external records, buckets, batches and set-level rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import arrays as A
from sluice.functions import text as X
from sluice.operators import validate as V
from sluice.operators.identity import content_key
from sluice.operators.reject import first_reason, strictly_increasing
from sluice.plans.catalog import Tables, query


@query("""SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 'missing_text' WHEN n_chars % 6 NOT BETWEEN 1 AND 4 THEN 'reference_count_out_of_range' WHEN doc_id % 7 = 0 THEN 'path_not_absolute' WHEN doc_id % 11 = 0 THEN 'unsafe_id' WHEN doc_id % 13 = 0 THEN 'not_a_plain_filename' END AS reason FROM documents""")
def external_record_check(t: Tables) -> DataFrame:
    """Text, one to four references with absolute paths, a safe id and a plain file name."""
    n = F.col("n_chars") % 6
    path = F.when(F.col("doc_id") % 7 == 0, "img/a.png").otherwise("/data/img/a.png")
    refs = F.array_repeat(path, n.cast("int"))
    name = F.when(F.col("doc_id") % 13 == 0, "a/b.mp4").otherwise("b.mp4")
    key = F.when(F.col("doc_id") % 11 == 0, "../x").otherwise(F.concat(F.lit("x"), "doc_id"))
    return t.documents.select("doc_id", V.external_reason(F.col("text"), refs, key, name).alias("reason"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'sample_key_mismatch' END AS reason FROM documents""")
def record_key_check(t: Tables) -> DataFrame:
    """A normalised record's stored key against one recomputed from its fields."""
    docs = t.documents
    stored = docs.withColumn("key", F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(content_key(docs, "lang", "source", "text")))
    return stored.select("doc_id", F.when(F.col("key") != content_key(docs, "lang", "source", "text"), "sample_key_mismatch").alias("reason"))


@query("""SELECT doc_id, CASE WHEN h <= 1 OR w <= 1 THEN 'degenerate_vlm_reference_geometry' WHEN c <> 3 THEN 'invalid_vlm_reference_tensor' END AS reason FROM (SELECT doc_id, n_chars % 50 AS h, n_chars // 7 % 40 AS w, CASE WHEN doc_id % 8 = 0 THEN 4 ELSE 3 END AS c FROM documents) WHERE true""")
def reference_shape_check(t: Tables) -> DataFrame:
    """Decoded references need edges over one pixel and three channels."""
    h, w = F.col("n_chars") % 50, F.floor(F.col("n_chars") / 7) % 40
    channels = F.when(F.col("doc_id") % 8 == 0, 4).otherwise(3)
    return t.documents.select("doc_id", first_reason([("degenerate_vlm_reference_geometry", (h <= 1) | (w <= 1)), ("invalid_vlm_reference_tensor", channels != 3)]).alias("reason"))


@query("""SELECT conv_id, CASE WHEN bool_or(x < 0) THEN 'negative' WHEN bool_or(x <= p) THEN 'not_sorted_unique' END AS reason FROM (SELECT conv_id, x, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, (turn * 5 - length(text) % 9)::INT AS x FROM conversations)) GROUP BY 1""")
def index_list_check(t: Tables) -> DataFrame:
    """Lists of indices must be non-negative, sorted and unique."""
    rows = t.conversations.select("conv_id", F.struct("turn", (F.col("turn") * 5 - F.length("text") % 9).cast("int").alias("x")).alias("s"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", F.col("s.x").alias("xs"))  # a conversation's turns
    return lists.select("conv_id", F.when(F.array_min("xs") < 0, "negative").when(~strictly_increasing(F.col("xs")), "not_sorted_unique").alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size < 9 AND p_partkey % 4 > 0 THEN 'too_few_frames' WHEN p_size * 0.04 < 0.5 AND p_partkey % 4 > 0 THEN 'audio_too_short' WHEN p_partkey % 4 > 0 AND p_size % 25 < 3 THEN 'scene_too_short' END AS reason FROM part""")
def media_length_check(t: Tables) -> DataFrame:
    """Too few frames (images exempt), audio shorter than the smallest bucket, scenes below a duration."""
    video = F.col("p_partkey") % 4 > 0
    return t.part.select("p_partkey", first_reason([("too_few_frames", video & (F.col("p_size") < 9)), ("audio_too_short", video & (F.col("p_size") * 0.04 < 0.5)), ("scene_too_short", video & (F.col("p_size") % 25 < 3))]).alias("reason"))


@query("""SELECT p_partkey, w, h, f, w % 32 = 0 AND h % 32 = 0 AND f % 8 = 1 AS fits, (w // 2) % 32 = 0 AND (h // 2) % 32 = 0 AND f % 8 = 1 AS fits_halved FROM (SELECT p_partkey, 16 * (1 + p_partkey % 60) AS w, 32 * p_size AS h, 1 + p_partkey % 130 AS f FROM part)""")
def bucket_dims_check(t: Tables) -> DataFrame:
    """Width and height by 32, frames one more than a multiple of 8; the same after halving the picture."""
    rows = t.part.select("p_partkey", (16 * (1 + F.col("p_partkey") % 60)).alias("w"), (32 * F.col("p_size")).alias("h"), (1 + F.col("p_partkey") % 130).alias("f"))
    half = lambda c: F.floor(F.col(c) / 2)
    return rows.select("*", V.bucket_fits(F.col("w"), F.col("h"), F.col("f")).alias("fits"), V.bucket_fits(half("w"), half("h"), F.col("f")).alias("fits_halved"))


@query("""SELECT batch, count(DISTINCT event_type) = 1 AS one_task, count(DISTINCT user_id % 3) = 1 AS one_shape FROM (SELECT *, event_id // 2 AS batch FROM events) GROUP BY 1""")
def microbatch_check(t: Tables) -> DataFrame:
    """A microbatch must hold one task and one shape."""
    one = lambda c: F.min(c) == F.max(c)
    rows = t.events.select(F.floor(F.col("event_id") / 2).alias("batch"), "event_type", (F.col("user_id") % 3).alias("shape"))
    return rows.groupBy("batch").agg(one("event_type").alias("one_task"), one("shape").alias("one_shape"))


@query("""SELECT source, count(*) = count(nullif(trim(text, ' '), '')) AS captions_present, count(*) = count(*) FILTER (n_chars > 0) AS media_present, count(DISTINCT n_chars % 3) AS buckets, count(DISTINCT n_chars % 3) = 1 AS single_bucket FROM documents GROUP BY 1""")
def dataset_presence_check(t: Tables) -> DataFrame:
    """Whether every row has a caption and media, how many buckets there are, and whether it is one."""
    bucket = F.collect_set(F.col("n_chars") % 3)  # three values at most
    got = t.documents.groupBy("source").agg(F.bool_and(F.trim("text") != "").alias("captions_present"), F.bool_and(F.col("n_chars") > 0).alias("media_present"), F.size(bucket).alias("buckets"))
    return got.withColumn("single_bucket", F.col("buckets") == 1)


@query("SELECT id FROM (SELECT unnest([0, 5, 17, 99999991, 99999992]) AS id) WHERE id NOT IN (SELECT doc_id FROM documents)")
def explicit_ids_missing(t: Tables) -> DataFrame:
    """Explicitly wanted ids that no row has; there must be none."""
    wanted = t.spark.createDataFrame([(i,) for i in (0, 5, 17, 99999991, 99999992)], "id long")
    return wanted.join(t.documents.select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("""SELECT p_partkey, CASE WHEN p_size * 3 - p_partkey % 20 < 121 THEN 'insufficient_face_cut_span_for_121' END AS reason FROM part""")
def span_prefilter(t: Tables) -> DataFrame:
    """Face cuts of fewer than 121 frames go before any probing."""
    return t.part.select("p_partkey", V.span_reason(F.col("p_partkey") % 20, F.col("p_size") * 3).alias("reason"))


@query("""SELECT event_id, CASE WHEN value > 95 THEN 'video_probe_timeout' WHEN value IS NULL THEN 'missing_target' WHEN value < 2 THEN 'video_probe_worker_crash' WHEN event_type = 'error' THEN 'RuntimeError' END AS reason FROM events""")
def probe_error_reasons(t: Tables) -> DataFrame:
    """Outcomes of probing as reasons; any other error gives its own class name."""
    status = F.when(F.col("value") > 95, "timeout").when(F.col("value").isNull(), "missing_media").when(F.col("value") < 2, "crash").when(F.col("event_type") == "error", "RuntimeError")
    return t.events.select("event_id", V.probe_reason(status).alias("reason"))


@query("""SELECT source, doc_id FROM documents WHERE source IN ('src1', 'src2', 'src5') OR lang = 'fr'""")
def block_list_membership(t: Tables) -> DataFrame:
    """A list of wanted values, where no list at all lets everything through."""
    wanted = F.when(F.col("lang") != "fr", F.array(*[F.lit(x) for x in ("src1", "src2", "src5")]))
    return t.documents.where(A.in_list(F.col("source"), wanted)).select("source", "doc_id")


@query("""SELECT conv_id, bool_and(coalesce(length(text) > p, true)) AS increasing, count(*) > 0 AS filled FROM (SELECT conv_id, text, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1""")
def strictly_increasing_lists(t: Tables) -> DataFrame:
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("s"))  # a conversation's turns
    return lists.select("conv_id", strictly_increasing(F.col("s.n")).alias("increasing"), (F.size("s") > 0).alias("filled"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'i2i_schema_mismatch' WHEN trim(text, ' ') = '' THEN 'empty_caption' WHEN n_chars % 5 = 0 THEN 'missing_reference' END AS reason FROM documents""")
def i2i_normalize(t: Tables) -> DataFrame:
    """Image pairs through the adapter registry."""
    from sluice.sources import adapters

    rows = t.documents.select(F.col("doc_id").alias("source_record_id"), F.when(F.col("lang") != "de", F.concat(F.lit("img/"), "doc_id")).alias("image"), F.when(F.col("n_chars") % 5 == 0, " ; ").otherwise("a.png;b.png").alias("edit_image"), F.col("text").alias("prompt"))
    got = adapters.normalize(rows, "i2i", adapters.Settings(data_root="/data"))
    return got.select(F.col("source_record_id").cast("long").alias("doc_id"), "reason")


@query("""SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 'phantom_empty_caption' WHEN doc_id % 4 = 0 THEN 'phantom_missing_cross_pair' END AS reason FROM documents""")
def cross_pair_required(t: Tables) -> DataFrame:
    """Rows of a dataset that needs cross pairs, without one."""
    from sluice.sources import adapters

    rows = t.documents.select(F.col("doc_id").alias("source_record_id"), F.lit("v.mp4").alias("video_path"), F.struct(F.col("text").alias("video_caption")).alias("metadata"), F.array(F.lit("r.png")).alias("cropped_ref_paths"), F.when(F.col("doc_id") % 4 != 0, F.lit("pair")).alias("cross_pair"))
    got = adapters.normalize(rows, "phantom", adapters.Settings(data_root="/data", dataset="p"))
    return got.select(F.col("source_record_id").cast("long").alias("doc_id"), "reason")


@query("""SELECT key, n FROM (SELECT left(sha256(source || lang), 2) AS key, count(*) AS n FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1) WHERE n > 1""")
def duplicate_key_check(t: Tables) -> DataFrame:
    keys = t.documents.select("source", "lang").distinct().select(F.substring(F.sha2(F.concat("source", "lang"), 256), 1, 2).alias("key"))
    return V.duplicate_keys(keys, "key")


@query(r"""SELECT conv_id, turn, 'Wan, ' || text AS caption, CASE WHEN regexp_matches(role, '^(user|assistant)$') THEN 'ok' END AS known FROM conversations""")
def trigger_prefix(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.with_trigger(" Wan, ", F.col("text")).alias("caption"), F.when(F.col("role").isin("user", "assistant"), "ok").alias("known"))
