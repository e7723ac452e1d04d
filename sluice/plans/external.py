"""Evaluation sets from outside, selection bundles, reference checks, and manifests without an index."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import bundles as B
from sluice.operators.identity import content_key
from sluice.operators.publish import PathPolicy
from sluice.operators.sampling import first_k, hash_order
from sluice.operators.tokens import collated
from sluice.operators.validate import ratio_problems
from sluice.plans.catalog import Tables, query
from sluice.plans.records import _PREPARED, prepared
from sluice.session import kept, shared_dir
from sluice.sources import discovery
from sluice.sources import external as E
from sluice.sources.manifests import scan_manifest
from sluice.sources.offsets import read_entries
from sluice.sources.prepare import finalize


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/sluice/{name}-{uuid.uuid4().hex}"


def _records(t: Tables) -> DataFrame:
    """Customers as records of an evaluation set, some of which cannot be taken."""
    k = F.col("c_custkey")
    id_ = F.when(k % 11 == 2, F.lit(" ")).when(k % 7 == 1, F.concat(F.lit("a/"), k)).when(k % 9 == 4, F.concat(F.lit("dup"), F.floor(k / 20))).when(k % 5 == 3, F.concat(F.lit("c_"), k - 1)).otherwise(F.concat(F.lit("c "), k))
    one = lambda j: F.concat(F.when(k % 17 == 0, F.lit("q/")).otherwise(F.lit("/r/./x/../q//")), j, F.lit(".png"))
    refs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.when(j <= k % 6, one(j))), lambda x: x.isNotNull())
    text = F.when(k % 23 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "c_name"))
    whole = F.to_json(F.struct(id_.alias("id"), text.alias("prompt"), refs.alias("ref_images")))
    no_list = F.to_json(F.struct(id_.alias("id"), text.alias("prompt"), F.lit("x").alias("ref_images")))
    return t.customer.select(k.cast("string").alias("source_index"), F.when(k % 19 == 0, F.lit("[1]")).when(k % 29 == 0, no_list).otherwise(whole).alias("raw"))


def _normalized(t: Tables) -> DataFrame:
    return E.normalize_external(_records(t), "videoxfun_test", "/sets/a/test.json")


_EXTERNAL = r"""
WITH c AS (SELECT c_custkey AS k, c_name, c_custkey % 6 AS refs, CASE WHEN c_custkey % 11 = 2 THEN ' ' WHEN c_custkey % 7 = 1 THEN 'a/' || c_custkey WHEN c_custkey % 9 = 4 THEN 'dup' || (c_custkey // 20) WHEN c_custkey % 5 = 3 THEN 'c_' || (c_custkey - 1) ELSE 'c ' || c_custkey END AS id FROM customer),
p AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'not_an_object' WHEN id = ' ' THEN 'missing_id' WHEN k % 23 = 0 THEN 'empty_caption' WHEN k % 29 = 0 THEN 'references_not_a_list' WHEN refs NOT BETWEEN 1 AND 4 THEN 'reference_count_out_of_range'
  WHEN k % 17 = 0 THEN 'reference_not_absolute' WHEN contains(id, '/') THEN 'unsafe_id' END AS problem FROM c),
e AS (SELECT *, k::VARCHAR AS source_index, CASE WHEN problem IS NULL THEN regexp_replace(id, '[^A-Za-z0-9._-]+', '_', 'g') END AS output_id FROM p)
"""


@query(
    _EXTERNAL
    + """SELECT source_index, problem, output_id, CASE WHEN problem IS NULL THEN sha256('videoxfun_test' || chr(0) || id) END AS sample_key, CASE WHEN problem IS NULL THEN c_name END AS caption,
  CASE WHEN problem IS NULL THEN array_to_string(list_transform(range(1, refs + 1), lambda j: '/r/q/' || j || '.png'), ',') END AS refs FROM e"""
)
def external_normalize(t: Tables) -> DataFrame:
    """Records of an evaluation set as normalised ones, or the first problem of each."""
    return _normalized(t).select("source_index", "problem", "output_id", "sample_key", "caption", F.array_join("reference_paths", ",").alias("refs"))


@query(
    _EXTERNAL
    + """SELECT source_index, 'record' AS error_type, problem, 1 AS n FROM e WHERE problem IS NOT NULL
UNION ALL SELECT id, 'duplicate_source_id', id, count(*) FROM e WHERE problem IS NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT output_id, 'output_id_collision', output_id, count(*) FROM e WHERE problem IS NULL GROUP BY output_id HAVING count(*) > 1"""
)
def external_set_errors(t: Tables) -> DataFrame:
    """All that is wrong with an evaluation set: records, ids that come twice, output ids that several records take."""
    return E.external_errors(_normalized(t))


@query(
    _EXTERNAL
    + """SELECT row_number() OVER (ORDER BY k) AS line_number, id AS source_record_id, CASE k % 8 WHEN 0 THEN 'caption_or_references' WHEN 1 THEN 'geometry_mismatch' WHEN 2 THEN 'sample_key_mismatch' WHEN 3 THEN 'output_id_mismatch' WHEN 4 THEN 'schema_version_or_task' WHEN 5 THEN 'reference_counts_differ' END AS problem FROM e WHERE problem IS NULL"""
)
def normalized_manifest_check(t: Tables) -> DataFrame:
    """A normalised manifest, some of whose records were changed, read back line by line under all checks."""
    path = _place(t, "normalized")
    kind, k = F.col("source_index").cast("long") % 8, F.col("source_index").cast("long")
    changed = {"caption": (0, F.lit("\t")), "width": (1, F.lit(833)), "sample_key": (2, F.lit("x")), "output_id": (3, F.lit("other")), "task": (4, F.lit("i2i")), "original_reference_paths": (5, F.slice("original_reference_paths", 2, 4))}
    rows = _normalized(t).where("problem is null").withColumn("_k", k)
    rows = rows.withColumns({c: F.when(kind == n, v).otherwise(F.col(c)) for c, (n, v) in changed.items()})
    ordered = rows.repartitionByRange("_k").sortWithinPartitions("_k").drop("source_index", "problem", "_k")
    ordered.select(F.to_json(F.struct(*ordered.columns)).alias("value")).write.text(path)
    return E.check_normalized(t.spark, path).select("line_number", "source_record_id", "problem")


@query("SELECT kind, 'n' || n_nationkey AS output_id, '/' || CASE kind WHEN 'object' THEN 'sets/ref/' ELSE 'ref/' END || n_name || '.png' AS ref FROM nation, (SELECT unnest(['list', 'object']) AS kind)")
def external_file_scan(t: Tables) -> DataFrame:
    """JSON files of two layouts, a list and an object keyed by record, read under a policy of allowed roots."""
    root = _place(t, "sets")
    policy = PathPolicy([root], [f"{root}/secret"])
    key = F.concat(F.lit("n"), "n_nationkey")
    in_list = F.struct(F.concat(key, F.lit(".mp4")).alias("video_name"), F.col("n_name").alias("caption"), F.array(F.concat(F.lit("/ref/"), "n_name", F.lit(".png"))).alias("ref_image_paths"))
    in_object = F.struct(F.col("n_name").alias("prompt"), F.array(F.concat(F.lit("ref/"), "n_name", F.lit(".png"))).alias("img_paths"))
    rows = t.nation.coalesce(1)  # 25 rows: such a file is one value
    rows.agg(F.to_json(F.collect_list(in_list)).alias("value")).write.text(f"{root}/list.json")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), in_object.alias("v"))))).alias("value")).write.text(f"{root}/object.json")
    out = None
    for kind, dataset in (("list", "custom64"), ("object", "opens2v_open_domain")):
        raw = E.read_external(t.spark, f"{root}/{kind}.json", dataset, policy)
        got = E.normalize_external(raw, dataset, f"/sets/{kind}.json").select(F.lit(kind).alias("kind"), "output_id", F.get("reference_paths", 0).alias("ref"))
        out = got if out is None else out.unionAll(got)
    return out


@query("""SELECT task, sample_key, position, array_to_string(['reference_00.parquet', 'reference_01.parquet'][1:n], ',') AS refs, n AS readable FROM (
  SELECT CASE WHEN lang = 'en' THEN 'r2v' ELSE 'i2i' END AS task, lang || '/' || doc_id AS sample_key, row_number() OVER (ORDER BY lang, doc_id) AS position, doc_id % 3 AS n FROM (
    SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('pick:' || doc_id), doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= 6)""")
def selection_bundle(t: Tables) -> DataFrame:
    """Six samples a language published as a bundle (prompts and copies of references written by tasks) and read back in order."""
    docs = t.documents.where("lang is not null").withColumn("h", hash_order("pick", "doc_id"))
    some = first_k(docs, ["lang"], ["h", "doc_id"], 6)
    files = F.array(*[F.lit(f"{t.sf_dir}/{n}.parquet") for n in ("region", "nation")])
    samples = some.select("lang", "doc_id", F.when(F.col("lang") == "en", "r2v").otherwise("i2i").alias("task"), F.concat("lang", F.lit("/"), "doc_id").alias("sample_key"), F.col("text").alias("caption"), F.slice(files, 1, (F.col("doc_id") % 3).cast("int")).alias("reference_paths"))
    root = _place(t, "bundle")
    B.write_bundle(samples, root, ["lang", "doc_id"])
    got = B.read_bundle(t.spark, root, samples.schema)
    base = B.Current(t.spark, root).read("references", content=True)
    there = base.groupBy("sample_dir").agg(F.count(F.lit(1)).alias("readable"))
    folder = F.regexp_extract(F.get("reference_paths", 0), "sample_dir=([^/]+)/", 1)
    names = F.array_join(F.transform("reference_paths", lambda x: F.substring_index(x, "/", -1)), ",")
    return got.withColumn("sample_dir", folder).join(there, "sample_dir", "left").select("task", "sample_key", F.col("line_number").alias("position"), names.alias("refs"), F.coalesce("readable", F.lit(0)).alias("readable"))


@query(_PREPARED + "z AS (SELECT 1) SELECT k::VARCHAR AS source_record_id, coalesce(reason, CASE WHEN refs >= 3 THEN 'missing_reference' END) AS reason FROM r")
def deferred_references(t: Tables) -> DataFrame:
    """References are looked up last, for rows that stood all other checks; the third one is not readable."""
    readable = t.region.select(F.concat(F.lit("/m/r"), F.col("r_regionkey") + 1, F.lit(".png")).alias("path"), (F.col("r_regionkey") != 2).alias("ok"))
    return finalize(kept(prepared(t), "prepared"), readable).select("source_record_id", "reason")


@query(
    _PREPARED
    + """v AS (SELECT k, k % 8 AS kind FROM r WHERE reason IS NULL)
SELECT k::VARCHAR AS source_record_id, CASE kind WHEN 0 THEN 'plan_hash_mismatch' WHEN 1 THEN 'blank_field' WHEN 2 THEN 'unknown_task' WHEN 3 THEN 'video_fps' WHEN 4 THEN 'image_not_one_frame' WHEN 5 THEN 'no_references' WHEN 6 THEN 'anchor_sources' END AS problem, CASE kind WHEN 2 THEN 'unknown_task' END AS compact FROM v"""
)
def manifest_scan(t: Tables) -> DataFrame:
    """A manifest without an index: every line validated in full, or only its task; the lines are then read at the offsets found."""
    path = _place(t, "manifest")
    kind = F.col("source_record_id").cast("long") % 8
    when = lambda n, v, c: F.when(kind == n, v).otherwise(F.col(c))
    rows = prepared(t).where("reason is null").drop("reason", "sample_plan_sha256").withColumns({"dataset_name": F.lit("d"), "adapter_name": F.lit("opens2v"), "target_modality": F.lit("video"), "original_fps": F.col("source_fps"), "target_num_frames": F.lit(121), "target_fps": F.when(kind == 3, 25.0).otherwise(24.0)})
    anchors = F.col("semantic_anchor_source_indices")
    rows = rows.withColumns({"sample_key": when(1, F.lit(" "), "sample_key"), "task": F.when(kind == 2, "x2v").when(kind == 4, "i2i").otherwise("r2v"), "reference_paths": when(5, F.array().cast("array<string>"), "reference_paths"), "semantic_anchor_source_indices": when(6, F.concat(F.slice(anchors, 1, 11), F.array(F.get(anchors, 11) + 1)), "semantic_anchor_source_indices")})
    rows = kept(rows, "rows")
    rows = rows.withColumn("sample_plan_sha256", content_key(rows, *rows.columns)).withColumn("caption", when(0, F.concat("caption", F.lit("é")), "caption"))
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    full = scan_manifest(t.spark, path, rows.schema)
    compact = scan_manifest(t.spark, path, rows.schema, compact=True).select("row", F.col("problem").alias("compact"))
    return read_entries(full).join(compact, "row").select(F.get_json_object("line", "$.source_record_id").alias("source_record_id"), "problem", "compact")


@query("""WITH n AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), r AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS ratio, ascii(right(source, 1)) % 3 AS kind FROM n),
p AS (SELECT source, CASE WHEN kind = 1 AND lang = 'de' THEN -ratio WHEN kind = 2 THEN ratio / 2 ELSE ratio END AS ratio FROM r)
SELECT source, CASE WHEN bool_or(ratio < 0) THEN 'negative' WHEN count(*) <> (SELECT count(DISTINCT lang) FROM documents) THEN 'names_differ' WHEN abs(sum(ratio) - 1) > 1e-8 THEN 'sum_is_not_one' END AS problem FROM p GROUP BY 1""")
def sampling_ratio_check(t: Tables) -> DataFrame:
    """Each source's ratios of languages, some of them wrong, against the languages that there are."""
    docs = t.documents.where("lang is not null and source is not null")
    each = docs.groupBy("source", F.col("lang").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ratio = F.col("n") / F.col("total")
    kind = F.ascii(F.substring("source", -1, 1)) % 3
    rows = each.join(each.groupBy("source").agg(F.sum("n").alias("total")), "source").select("source", "name", F.when((kind == 1) & (F.col("name") == "de"), -ratio).when(kind == 2, ratio / 2).otherwise(ratio).alias("ratio"))
    return ratio_problems(rows, docs.select(F.col("lang").alias("name")), ["source"])


@query("""SELECT change, task, task = 'i2i' AND change IN ('seed', 'rows') OR task = 'r2v' AND change = 'seed' AS rebuild, length(task) > 0 AND (SELECT count(*) FROM part) > 0 AS hashed FROM (SELECT unnest(['workers', 'seed', 'rows']) AS change), (SELECT unnest(['i2i', 'r2v']) AS task)""")
def task_fingerprints(t: Tables) -> DataFrame:
    """Which tasks a change asks to build anew: other workers none, another seed all, a source with a row more its own task."""
    config = {"datasets": [{"name": n, "task": task, "path": n} for n, task in (("part", "i2i"), ("supplier", "r2v"), ("orders", "i2i"))]}
    settings = {"shards_per_task": 8, "manifest_seed": 1, "workers": 4}
    found = discovery.discover(config, lambda n: getattr(t, n).count(), ("i2i", "r2v"))
    more = [replace(s, rows=s.rows + 1, task_end_row=s.task_end_row + 1) if s.name == "orders" else s for s in found]
    builds = {"workers": (found, settings | {"workers": 9}), "seed": (found, settings | {"manifest_seed": 2}), "rows": (more, settings)}
    rows = []
    for change, (sources, options) in builds.items():
        for task in ("i2i", "r2v"):
            old, new = discovery.task_fingerprint(task, found, settings), discovery.task_fingerprint(task, sources, options)
            rows.append((change, task, old != new, len(new) == 64))
    return t.spark.createDataFrame(rows, "change string, task string, rebuild boolean, hashed boolean")


@query("""WITH e AS (SELECT event_id, event_id // 4 AS batch, event_type AS task, user_id % 2 AS shape, CASE WHEN value IS NULL OR value > 95 THEN 'failed ' || event_id END AS error FROM events),
b AS (SELECT batch, count(*) AS n, count(error) AS failed, array_to_string(list(error ORDER BY event_id) FILTER (error IS NOT NULL), ',') AS errors, array_to_string(list(event_id ORDER BY event_id), ',') AS ids, count(DISTINCT task) AS tasks, count(DISTINCT shape) AS shapes FROM e GROUP BY 1)
SELECT batch, n, coalesce(errors, '') AS errors, CASE WHEN failed = 0 AND tasks = 1 AND shapes = 1 THEN ids END AS ids, CASE WHEN failed = 0 AND tasks > 1 THEN 'mixed_tasks' WHEN failed = 0 AND shapes > 1 THEN 'mixed_shapes' END AS problem FROM b""")
def microbatch_collation(t: Tables) -> DataFrame:
    """Microbatches of four samples as lists, or the errors of samples that failed to load, or why they do not fit together."""
    failed = F.col("value").isNull() | (F.col("value") > 95)
    rows = t.events.select("event_id", F.floor(F.col("event_id") / 4).alias("batch"), F.col("event_type").alias("task"), (F.col("user_id") % 2).alias("shape"), F.when(failed, F.concat(F.lit("failed "), "event_id")).alias("error"))
    got = collated(rows, "batch", ["event_id"], ["event_id"])
    return got.select("batch", "n", F.array_join("errors", ",").alias("errors"), F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"), "problem")
