"""Readers and sinks: whole tables written to the shared folder in some format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import publish as P
from sluice.plans.catalog import Tables, query
from sluice.session import shared_dir
from sluice.sources import annotations as A
from sluice.operators import generations as G
from sluice.sources import discovery


def _place(t: Tables, suffix: str = "") -> str:
    return f"{shared_dir(t.spark)}/sluice/files-{uuid.uuid4().hex}{suffix}"


_ROWS = "SELECT event_id AS id, event_type AS kind, value FROM events"


def _rows(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")


@query(_ROWS)
def scan_parquet(t: Tables) -> DataFrame:
    path = _place(t, ".parquet")
    _rows(t).write.parquet(path)
    return A.scan(t.spark, path).select("id", "kind", "value")


@query(_ROWS)
def scan_jsonl(t: Tables) -> DataFrame:
    path = _place(t, ".jsonl")
    _rows(t).write.json(path)
    return A.scan(t.spark, path, "id long, kind string, value double")


@query("SELECT id::VARCHAR AS id, kind, round(value, 6) AS value FROM (SELECT event_id AS id, event_type AS kind, value FROM events)")
def scan_csv(t: Tables) -> DataFrame:
    """Values of a csv file stay strings."""
    path = _place(t, ".csv")
    _rows(t).write.option("header", True).csv(path)
    return A.scan(t.spark, path).select("id", "kind", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT n_nationkey AS id, n_name AS kind FROM nation")
def scan_json_list(t: Tables) -> DataFrame:
    """A JSON list of records."""
    path = _place(t, ".json")
    record = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind"))
    t.nation.coalesce(1).agg(F.to_json(F.collect_list(record)).alias("value")).write.text(path)  # 25 rows: such a file is one value
    return A.scan(t.spark, path, "id long, kind string")


@query("SELECT 'n' || n_nationkey AS _record_key, n_name AS name, n_regionkey AS region FROM nation")
def scan_json_records(t: Tables) -> DataFrame:
    """An object of records: its keys are the row ids."""
    path = _place(t, ".json")
    record = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    t.nation.coalesce(1).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("k"), record.alias("v"))))).alias("value")).write.text(path)  # 25 rows: such a file is one value
    return A.scan(t.spark, path).select("_record_key", "name", "region")


@query("SELECT count(*) AS parquet, count(*) AS jsonl, count(*) AS exact, true AS csv_unknown FROM events")
def row_counts(t: Tables) -> DataFrame:
    """Cheap row counts by format: footers, lines, none for csv; and the exact count."""
    place = _place(t)
    rows = _rows(t)
    rows.write.parquet(place + ".parquet")
    rows.write.json(place + ".jsonl")
    found = [(A.row_count(t.spark, place + ".parquet"), A.row_count(t.spark, place + ".jsonl"), A.scan(t.spark, place + ".parquet").count(), A.row_count(t.spark, place + ".csv") is None)]
    return t.spark.createDataFrame(found, "parquet long, jsonl long, exact long, csv_unknown boolean")


@query("SELECT name, task, \"order\", least(s, 1000)::BIGINT AS task_start_row, least(s + n, 1000)::BIGINT AS task_end_row FROM (SELECT *, sum(n) OVER (PARTITION BY task ORDER BY \"order\") - n AS s FROM (SELECT 'src_nation' AS name, 'i2i' AS task, 0 AS \"order\", (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'src_part', 'r2v', 1, (SELECT count(*) FROM part) UNION ALL SELECT 'src_region', 'i2i', 2, (SELECT count(*) FROM region) UNION ALL SELECT 'src_supplier', 'r2v', 3, (SELECT count(*) FROM supplier) UNION ALL SELECT 'src_orders', 'r2v', 4, (SELECT count(*) FROM orders))) WHERE s < 1000 AND n > 0")
def discovered_sources(t: Tables) -> DataFrame:
    """Row ranges of configured sources, with a cap of 1,000 rows a task (the feature's cap); sources beyond it are left out."""
    config = {"datasets": [{"name": f"src_{n}", "task": task, "path": f"{t.sf_dir}/{n}.parquet"} for n, task in (("nation", "i2i"), ("part", "R2V"), ("region", "I2I"), ("supplier", "r2v"), ("orders", "r2v"))]}
    found = discovery.discover(config, lambda path: t.spark.read.parquet(path).count(), discovery.parse_tasks("R2V,i2i"), 1000)
    rows = [(s.name, s.task, s.order, s.task_start_row, s.task_end_row) for s in found]
    return t.spark.createDataFrame(rows, "name string, task string, `order` int, task_start_row long, task_end_row long")


@query("SELECT '/data/' || p_partkey || '.mp4' AS path FROM part WHERE p_partkey % 9 > 0")
def metadata_paths(t: Tables) -> DataFrame:
    """A path column of a metadata file, resolved against the file's folder; blank cells are left out."""
    path = _place(t, ".csv")
    cell = F.when(F.col("p_partkey") % 9 == 0, F.lit(" ")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/data/"), "p_partkey", F.lit(".mp4"))).otherwise(F.concat(F.lit(" "), "p_partkey", F.lit(".mp4")))
    t.part.select(F.col("p_partkey").alias("id"), cell.alias("media")).write.option("header", True).option("quoteAll", True).csv(path)
    return A.media_column(A.scan(t.spark, path), "media", "/data")


@query("SELECT unnest(['caption', 'reference_video', 'video']) AS role, unnest(['caption', 'ref_media_path', 'media_path']) AS col")
def column_roles(t: Tables) -> DataFrame:
    """Roles of a dataset's columns, sniffed from its header."""
    from sluice.sources.adapters import role_columns

    path = _place(t, ".csv")
    t.region.select(F.lit("c").alias("caption"), F.lit("m").alias("media_path"), F.lit("r").alias("ref_media_path")).write.option("header", True).csv(path)
    return t.spark.createDataFrame(sorted(role_columns(A.scan(t.spark, path).columns).items()), "role string, col string")


_CAPTIONS = "SELECT 'v/' || n_nationkey || '.mp4' AS path, n_name AS caption FROM nation"


def _captions(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("v/"), "n_nationkey", F.lit(".mp4")).alias("path"), F.col("n_name").alias("caption"))


@query(f"SELECT kind, path, caption FROM ({_CAPTIONS}), (SELECT unnest(['csv', 'jsonl', 'txt']) AS kind)")
def caption_round_trip(t: Tables) -> DataFrame:
    """Captions saved in three formats and loaded again."""
    out = None
    for kind in ("csv", "jsonl", "txt"):
        base = _place(t, "" if kind == "txt" else f".{kind}")
        P.save_captions(_captions(t), base, kind)
        got = A.caption_pairs(t.spark, f"{base}/captions", f"{base}/paths") if kind == "txt" else A.scan(t.spark, base)
        got = got.select(F.lit(kind).alias("kind"), "path", "caption")
        out = got if out is None else out.unionAll(got)
    return out


@query("SELECT 'k' || r_regionkey AS source_record_id, r_name AS name FROM region")
def records_as_lines(t: Tables) -> DataFrame:
    """Keyed records as JSON lines that carry their key."""
    path = _place(t, ".jsonl")
    P.records_to_jsonl(t.region.select(F.concat(F.lit("k"), "r_regionkey").alias("_record_key"), F.col("r_name").alias("name")), path)
    return A.scan(t.spark, path).select("source_record_id", "name")


@query("SELECT unnest(['accepted', 'rejected']) AS what, unnest([(SELECT count(*) FROM documents WHERE n_chars % 5 > 0), (SELECT count(*) FROM documents WHERE n_chars % 5 = 0)]) AS n, unnest([(SELECT sum(doc_id) FROM documents WHERE n_chars % 5 > 0), (SELECT sum(doc_id) FROM documents WHERE n_chars % 5 = 0)])::BIGINT AS ids")
def publish_round_trip(t: Tables) -> DataFrame:
    """Accepted and rejected rows published under an allowed root and read back; internal columns are gone."""
    root = _place(t)
    rows = t.documents.select("doc_id", F.lit(1).alias("_build_x"), F.when(F.col("n_chars") % 5 == 0, "fifth").alias("reason"))
    out = P.publish(rows, f"{root}/m", ["doc_id"], policy=P.PathPolicy([root], [f"{root}/secret"]))
    accepted, rejected = t.spark.read.parquet(out["accepted"]), t.spark.read.json(out["rejected"])
    if "_build_x" in accepted.columns:
        raise ValueError("internal columns were published")
    both = accepted.select(F.lit("accepted").alias("what"), "doc_id").unionAll(rejected.select(F.lit("rejected").alias("what"), "doc_id"))
    return both.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT lang AS task, (doc_id % 3)::INT AS shard, count(*) AS n_rows, true AS hashed, false AS written_again FROM documents GROUP BY ALL")
def shard_resume(t: Tables) -> DataFrame:
    """Shards with markers that hold their files' hashes: a second publish of the same build writes nothing."""
    path = _place(t)
    rows = t.documents.select(F.col("lang").alias("task"), (F.col("doc_id") % 3).cast("int").alias("shard"), "doc_id")
    P.publish_shards(rows, path, "f")
    again = P.publish_shards(rows, path, "f")
    hashed = F.forall("files", lambda f: (F.length(f.sha256) == 64) & (f.size > 0)) & (F.size("files") > 0)
    return P.done_shards(t.spark, path).select("task", "shard", "n_rows", hashed.alias("hashed"), F.lit(again > 0).alias("written_again"))


@query("SELECT lang AS task, count(*) AS raw, count(*) FILTER (n_chars % 5 > 0) AS accepted, count(*) FILTER (n_chars % 5 = 0) AS rejected FROM documents GROUP BY 1")
def resumed_shard_counters(t: Tables) -> DataFrame:
    """Counters of a build that ran in two parts, one of whose shards was damaged in between, merged from its markers."""
    path = _place(t)
    rows = t.documents.select(F.col("lang").alias("task"), (F.col("doc_id") % 3).cast("int").alias("shard"), "doc_id", F.when(F.col("n_chars") % 5 == 0, "fifth").alias("reason"))
    P.publish_shards(rows.where("shard < 2"), path, "f")
    rows.where("shard = 0").limit(1).drop("task", "shard").write.mode("append").parquet(f"{path}/data/task=en/shard=0")  # a stray file
    P.publish_shards(rows, path, "f")
    return P.shard_counters(t.spark, path, "f").groupBy("task").agg(F.sum("n_rows").alias("raw"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


@query("SELECT 'accepted' AS artefact, count(*) AS n, sum(doc_id)::BIGINT AS ids, 1 AS generation FROM documents WHERE n_chars % 3 > 0 UNION ALL SELECT 'rejected', count(*), sum(doc_id)::BIGINT, 1 FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT 'counts', count(DISTINCT source), NULL, 1 FROM documents")
def generation_round_trip(t: Tables) -> DataFrame:
    """Several tables published as one generation; a second one that fails before its switch leaves them as they are."""
    root = _place(t)
    docs = t.documents.select("doc_id", "source", "n_chars")
    with G.Generation(t.spark, root) as one:
        one.stage("accepted", docs.where("n_chars % 3 > 0"))
        one.stage("rejected", docs.where("n_chars % 3 = 0"), "json")
        one.stage("counts", docs.groupBy("source").count())
    try:
        with G.Generation(t.spark, root) as two:
            two.stage("accepted", docs.limit(1))
            raise InterruptedError
    except InterruptedError:
        pass
    now = G.Current(t.spark, root)
    parts = [now.read(n).select(F.lit(n).alias("artefact"), F.lit(1).alias("one"), (F.col("doc_id") if n != "counts" else F.lit(None).cast("long")).alias("id")) for n in ("accepted", "rejected", "counts")]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return both.groupBy("artefact").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.lit(len(now.history())).alias("generation"))


@query("SELECT count(*) AS n_rows, true AS all_hashed, 0 AS changed FROM part")
def artefact_hashes(t: Tables) -> DataFrame:
    """A published table's rows, and whether its files are as their stored hashes say."""
    root = _place(t)
    with G.Generation(t.spark, root) as one:
        one.stage("part", t.part)
    now = G.Current(t.spark, root)
    files = now.files()
    return now.read("part").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(all(len(f["sha256"]) == 64 for f in files)).alias("all_hashed"), F.lit(now.changed(content=True).count()).alias("changed"))


@query("SELECT r_name || '.pt' AS rel, 2 AS n_roots FROM region WHERE r_regionkey > 0")
def paired_files(t: Tables) -> DataFrame:
    """Files that lie at the same relative place under two roots."""
    base = _place(t)
    for i, root in enumerate(("latents", "conditions")):
        for r in t.region.where(F.col("r_regionkey") >= i).collect():  # five rows
            t.spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{base}/{root}/{r.r_name}.pt")
    found = A.shared_files(t.spark, [f"{base}/latents", f"{base}/conditions"], "part-*")
    return A.shared_folders(found).select("rel", "n_roots")


@query("SELECT unnest(['reject', 'reject2']) AS run, unnest([(SELECT count(*) FROM documents WHERE n_chars % 5 = 0), (SELECT count(*) FROM documents WHERE n_chars % 7 = 0)]) AS n")
def reject_log(t: Tables) -> DataFrame:
    """Rejects of two runs appended to one log."""
    path = _place(t, ".jsonl")
    for run, by in (("reject", 5), ("reject2", 7)):
        t.documents.where(F.col("n_chars") % by == 0).select(F.lit(run).alias("run"), "doc_id").write.mode("append").json(path)
    return A.scan(t.spark, path).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT line_number, raw FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS line_number, CASE WHEN n_nationkey % 5 = 2 THEN '' ELSE n_name END AS raw FROM nation) WHERE raw <> ''")
def numbered_jsonl_lines(t: Tables) -> DataFrame:
    """Physical line numbers of a text file; blank lines count but are left out."""
    path = _place(t, ".txt")
    t.nation.orderBy("n_nationkey").coalesce(1).select(F.when(F.col("n_nationkey") % 5 == 2, "").otherwise(F.col("n_name")).alias("value")).write.text(path)  # 25 rows
    return A.scan_lines(t.spark, path).select("line_number", "raw")


@query("SELECT n_name || '.MP4' AS name FROM nation WHERE n_nationkey % 2 = 0")
def media_file_discovery(t: Tables) -> DataFrame:
    """Files by extension, whatever its case, below a folder."""
    base = _place(t)
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".MP4").otherwise(".txt"))
    t.nation.select(name.alias("name"), F.lit("x").alias("value")).write.partitionBy("name").text(base)
    found = A.shared_folders(t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.substring_index("path", "/name=", -1).alias("rel"), F.lit(1).alias("n_roots"), "length"))
    return found.where(F.lower("rel").endswith(".mp4")).select(F.col("rel").alias("name"))
