"""Manifest index, point and range reads, shard checks, sampler state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import index as I
from sluice.operators import sampling as S
from sluice.plans.catalog import Tables, query
from sluice.session import shared_dir
from sluice.sources.offsets import build_index, open_index, read_entries, read_row_range


def _indexed(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("task"), F.col("source").alias("dataset"), "text")
    return I.line_index(rows, ["doc_id"], F.col("text")).select("row_index", "offset", "task", "dataset", "doc_id")


_INDEX = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1 AS \"offset\", lang AS task, source AS dataset, doc_id FROM documents"


@query(f'SELECT row_index, "offset"::BIGINT AS "offset", task, dataset FROM ({_INDEX})')
def manifest_index(t: Tables) -> DataFrame:
    """(row, byte offset, task, dataset) of every manifest line."""
    return _indexed(t).select("row_index", "offset", "task", "dataset")


@query(f'SELECT task, dataset, count(*) AS n, min(row_index) AS first_row, max(row_index) AS last_row, max("offset")::BIGINT AS last_offset FROM ({_INDEX}) GROUP BY ALL')
def index_groups(t: Tables) -> DataFrame:
    """What an index holds of each task and dataset."""
    return _indexed(t).groupBy("task", "dataset").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.max("offset").alias("last_offset"))


def _stored(t: Tables) -> tuple[DataFrame, str]:
    """The documents as files of JSON lines in the shared folder, in order of doc_id, and their stored index."""
    base = f"{shared_dir(t.spark)}/sluice/manifest-{uuid.uuid4().hex}"
    docs = t.documents.select("doc_id", "lang", "source", "n_chars", "text")
    line = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line).write.text(f"{base}/lines")
    build_index(t.spark, f"{base}/lines", f"{base}/index", {"task": "$.lang", "dataset": "$.source"})
    return open_index(t.spark, f"{base}/index", f"{base}/lines"), base


@query("SELECT row_index, doc_id, lang, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) WHERE row_index IN (0, 7, 19, 42, 150, 199)")
def index_point_read(t: Tables) -> DataFrame:
    """Rows read from their byte ranges, which a stored index gives for wanted row numbers."""
    entries, _ = _stored(t)
    lines = read_entries(entries.where(F.col("row").isin(0, 7, 19, 42, 150, 199)))
    record = F.from_json("line", "doc_id long, lang string, n_chars long, text string")
    return lines.select(F.col("row").alias("row_index"), record.alias("r")).select("row_index", "r.doc_id", "r.lang", "r.n_chars", F.sha2(F.coalesce("r.text", F.lit("")), 256).alias("text_sha256"))


@query("SELECT lang AS task, source AS dataset, count(*) AS n, min(i) AS first_row, max(i) AS last_row FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY ALL")
def stored_index_groups(t: Tables) -> DataFrame:
    """Rows of each task and dataset, from a stored index alone."""
    return _stored(t)[0].groupBy("task", "dataset").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@query("SELECT doc_id, row_index, sha256(coalesce(text, '')) AS text_sha256 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) WHERE lang = 'de' AND row_index BETWEEN 20 AND 180")
def index_range_read(t: Tables) -> DataFrame:
    """The rows of one task in a range of row numbers, each read from its byte range."""
    lines = read_entries(_stored(t)[0].where("task = 'de' and row between 20 and 180"))
    record = F.from_json("line", "doc_id long, text string")
    return lines.select("row", record.alias("r")).select("r.doc_id", F.col("row").alias("row_index"), F.sha2(F.coalesce("r.text", F.lit("")), 256).alias("text_sha256"))


@query("SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown_task' WHEN trim(text, ' ') = '' THEN 'empty_caption' WHEN n_chars > 5000 THEN 'too_long' END AS full_check, CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown_task' END AS compact_check FROM documents")
def index_fallback_scan(t: Tables) -> DataFrame:
    """Without an index every row is checked in full; the compact scan looks at the task only."""
    known = ~F.col("lang").isin("en", "de")
    full = F.when(known, "unknown_task").when(F.trim("text") == "", "empty_caption").when(F.col("n_chars") > 5000, "too_long")
    return t.documents.select("doc_id", full.alias("full_check"), F.when(known, "unknown_task").alias("compact_check"))


@query("""WITH m AS (SELECT doc_id AS row_index, lang AS task, source AS dataset FROM documents), i AS (SELECT row_index, CASE WHEN row_index % 11 = 3 THEN 'xx' ELSE task END AS task, CASE WHEN row_index % 13 = 5 THEN 'yy' ELSE dataset END AS dataset FROM m WHERE row_index % 17 <> 2 UNION ALL SELECT -1, 'en', 'src0')
SELECT coalesce(m.row_index, i.row_index) AS row_index, CASE WHEN m.row_index IS NULL THEN 'not_in_manifest' WHEN i.row_index IS NULL THEN 'not_in_index' WHEN m.task IS DISTINCT FROM i.task THEN 'task' WHEN m.dataset IS DISTINCT FROM i.dataset THEN 'dataset' END AS problem
FROM m FULL JOIN i ON m.row_index = i.row_index WHERE m.row_index IS NULL OR i.row_index IS NULL OR m.task IS DISTINCT FROM i.task OR m.dataset IS DISTINCT FROM i.dataset""")
def manifest_index_check(t: Tables) -> DataFrame:
    """An index with wrong tasks, wrong datasets, missing and surplus rows against its manifest."""
    m = t.documents.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("task"), F.col("source").alias("dataset"))
    task = F.when(F.col("row_index") % 11 == 3, "xx").otherwise(F.col("task"))
    dataset = F.when(F.col("row_index") % 13 == 5, "yy").otherwise(F.col("dataset"))
    i = m.where("row_index % 17 <> 2").select("row_index", task.alias("task"), dataset.alias("dataset"))
    return I.index_mismatches(m, i.unionAll(t.spark.createDataFrame([(-1, "en", "src0")], i.schema)), ["task", "dataset"])


@query("""SELECT source AS shard, CASE WHEN count(*) % 3 = 0 THEN 'version' WHEN max(doc_id) % 4 = 1 THEN 'fingerprint' WHEN max(n_chars) % 2 = 0 THEN 'sha256' END AS problem FROM documents GROUP BY 1""")
def shard_marker_check(t: Tables) -> DataFrame:
    """Which field of a shard's marker is stale: version, then build fingerprint, then artefact hash."""
    shards = t.documents.groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"), F.max("n_chars").alias("long"))
    marker = {"version": F.when(F.col("n") % 3 == 0, 2).otherwise(3), "fingerprint": F.when(F.col("last") % 4 == 1, "old").otherwise("now"), "sha256": F.sha2(F.when(F.col("long") % 2 == 0, "old").otherwise(F.col("shard")), 256)}
    expected = {"version": F.lit(3), "fingerprint": F.lit("now"), "sha256": F.sha2("shard", 256)}
    return shards.select("shard", I.marker_problem(marker, expected).alias("problem"))


@query("""WITH s AS (SELECT source AS shard, min(doc_id) AS a, max(doc_id) - 3 AS b, count(*) + 2 AS n FROM documents GROUP BY 1),
r AS (SELECT source AS shard, doc_id AS x, lag(doc_id) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p FROM documents)
SELECT shard, count(*) FILTER (x < a OR x >= b) AS outside, count(*) FILTER (x <= p) AS disordered, count(*) - max(n) AS surplus FROM r JOIN s USING (shard) GROUP BY 1""")
def shard_merge_check(t: Tables) -> DataFrame:
    """Rows out of order or range, and row counts against markers, of every shard."""
    shards = t.documents.groupBy(F.col("source").alias("shard")).agg(F.min("doc_id").alias("start"), (F.max("doc_id") - 3).alias("end"), (F.count(F.lit(1)) + 2).alias("n_rows"))
    rows = t.documents.select(F.col("source").alias("shard"), F.struct("n_chars", "doc_id").alias("position"), F.col("doc_id").alias("row_index"))
    return I.merge_problems(rows, shards)


@query("""WITH s AS (SELECT lang AS task, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY task ORDER BY source) AS b FROM s)
SELECT task, source, (greatest(10, b - n) - (b - n))::BIGINT AS local_start, (least(95, b) - (b - n))::BIGINT AS local_end FROM r WHERE b - n < 95 AND b > 10""")
def task_range_dispatch(t: Tables) -> DataFrame:
    """Rows 10 to 95 of each task as ranges of its concatenated sources."""
    sources = t.documents.groupBy(F.col("lang").alias("task"), "source").agg(F.count(F.lit(1)).alias("n"))
    return I.overlap_of_range(I.source_ranges(sources, ["task"], "source", "n"), 10, 95).select("task", "source", "local_start", "local_end")


@query("SELECT row_index, pmod, pick FROM (SELECT *, row_number() OVER (ORDER BY pmod) AS pick FROM (SELECT row_index, ((row_index - 5) * 7) % 25 + CASE WHEN ((row_index - 5) * 7) % 25 < 0 THEN 25 ELSE 0 END AS pmod FROM (SELECT n_nationkey AS row_index FROM nation))) WHERE pick <= 9")
def stride_walk_order(t: Tables) -> DataFrame:
    """The first nine rows of a walk that starts at 5 and steps by 18 (whose inverse mod 25 is 7)."""
    place = S.place_in_walk(F.col("n_nationkey"), 25, 5, 18)
    rows = t.nation.select(F.col("n_nationkey").alias("row_index"), place.alias("pmod"))
    return rows.withColumn("pick", F.row_number().over(Window.orderBy("pmod"))).where("pick <= 9")  # 25 rows


@query("""SELECT user_id, cursor // n AS epoch, cursor % n AS at, CASE WHEN cursor < 0 THEN 'negative_cursor' WHEN e <> cursor // n THEN 'epoch' WHEN a <> cursor % n THEN 'at' END AS problem FROM (
  SELECT user_id, count(*) * 7 AS cursor, 10 AS n, count(*) * 7 // 10 + (user_id % 5 = 0)::INT AS e, count(*) * 7 % 10 + (user_id % 7 = 0)::INT AS a FROM events GROUP BY 1)""")
def cursor_state_check(t: Tables) -> DataFrame:
    """A stored cursor's derived fields (epoch, place in it) against recomputed ones."""
    rows = t.events.groupBy("user_id").agg((F.count(F.lit(1)) * 7).alias("cursor"))
    epoch, at = F.floor(F.col("cursor") / 10), F.col("cursor") % 10
    stored_epoch, stored_at = epoch + (F.col("user_id") % 5 == 0).cast("int"), at + (F.col("user_id") % 7 == 0).cast("int")
    problem = F.when(F.col("cursor") < 0, "negative_cursor").when(stored_epoch != epoch, "epoch").when(stored_at != at, "at")
    return rows.select("user_id", epoch.alias("epoch"), at.alias("at"), problem.alias("problem"))


@query("""SELECT step, count(DISTINCT row) AS fresh, count(*) - count(DISTINCT row) AS repeats FROM (SELECT event_id // 50 AS step, user_id AS row FROM events) GROUP BY 1""")
def consumed_per_step(t: Tables) -> DataFrame:
    """Rows already taken within a step are skipped; the set is empty again at the next step."""
    rows = t.events.select(F.floor(F.col("event_id") / 50).alias("step"), F.col("user_id").alias("row"))
    return rows.groupBy("step", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("step").agg(F.count(F.lit(1)).alias("fresh"), F.sum(F.col("n") - 1).alias("repeats"))


@query("""WITH a AS (SELECT step, attempt, list(ok ORDER BY rank) AS oks FROM (SELECT s.step, a.attempt, r.rank, ascii(sha256(s.step || ':' || a.attempt || ':' || r.rank)) % 4 > 0 AS ok
  FROM (SELECT DISTINCT user_id AS step FROM events) s, (SELECT unnest(range(3)) AS attempt) a, (SELECT unnest(range(2)) AS rank) r) GROUP BY ALL)
SELECT step, min(attempt) FILTER (NOT list_contains(oks, false)) AS attempt, count(*) FILTER (NOT list_contains(oks, false)) = 0 AS failed FROM a GROUP BY step""")
def lockstep_retry(t: Tables) -> DataFrame:
    """All ranks go to the next attempt if one of them fails; after three attempts the step fails."""
    steps = t.events.select(F.col("user_id").alias("step")).distinct()
    draws = steps.select("step", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt")).select("step", "attempt", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("rank"))
    ok = F.ascii(F.sha2(F.concat_ws(":", "step", "attempt", "rank"), 256)) % 4 > 0
    every = draws.groupBy("step", "attempt").agg(F.bool_and(ok).alias("ok"))
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    return every.groupBy("step").agg(first.alias("attempt"), first.isNull().alias("failed"))


@query("""SELECT lang, doc_id, r::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('retry:' || doc_id), doc_id) - 1 AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id // 100 <> 1) WHERE r < 4""")
def retry_draw(t: Tables) -> DataFrame:
    """Replacement rows for four ranks of each task, in hashed order, without blocked rows and the failed block."""
    blocked = t.labels.where("quality = 0").select("doc_id").distinct()
    rows = t.documents.where(F.floor(F.col("doc_id") / 100) != 1).select("lang", "doc_id").join(blocked, "doc_id", "left_anti").withColumn("h", S.hash_order("retry", "doc_id"))
    got = S.first_k(rows, ["lang"], ["h", "doc_id"], 4)
    return got.select("lang", "doc_id", (F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")) - 1).alias("rank"))


@query("""SELECT block, user_id, r::INT AS slot FROM (SELECT block, user_id, row_number() OVER (PARTITION BY block ORDER BY f) - 1 AS r FROM (SELECT event_id // 64 AS block, user_id, min(event_id) AS f FROM events GROUP BY ALL))""")
def block_unique_stream(t: Tables) -> DataFrame:
    """A stream of draws in blocks of 64 without repeats inside a block: the first of each stays, in order."""
    firsts = t.events.groupBy(F.floor(F.col("event_id") / 64).alias("block"), "user_id").agg(F.min("event_id").alias("f"))
    return firsts.select("block", "user_id", (F.row_number().over(Window.partitionBy("block").orderBy("f")) - 1).alias("slot"))


_UNIT = "(('0x' || left(sha256('{}:' || doc_id), 13))::BIGINT / 4503599627370496.0)"


@query(f"""SELECT doc_id, round(u, 9) AS u, round(ln(u1 / (1 - u1)), 6) AS logit, flip, round(0.9 + 0.2 * s, 9) AS scale FROM (SELECT doc_id, {_UNIT.format('u')} AS u, greatest({_UNIT.format('u')}, 1e-6) AS u1, {_UNIT.format('flip')} < 0.5 AS flip, {_UNIT.format('scale')} AS s FROM documents)""")
def seeded_draws(t: Tables) -> DataFrame:
    """Uniform and logistic draws, a Bernoulli flip and a uniform scale from each sample's own seed."""
    u = S.unit("u", "doc_id")
    safe = F.greatest(u, F.lit(1e-6))
    return t.documents.select("doc_id", F.round(u, 9).alias("u"), F.round(F.log(safe / (1 - safe)), 6).alias("logit"), (S.unit("flip", "doc_id") < 0.5).alias("flip"), F.round(0.9 + 0.2 * S.unit("scale", "doc_id"), 9).alias("scale"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3') OR starts_with(source, 'src1')")
def id_prefix_filter(t: Tables) -> DataFrame:
    """Rows of wanted ids, or of ids with a wanted prefix."""
    return t.documents.where(F.col("source").isin("src1", "src3") | F.col("source").startswith("src1")).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id IN (SELECT doc_id FROM labels)")
def allow_list_union(t: Tables) -> DataFrame:
    """Rows whose id is in either of two allow-lists."""
    allowed = t.documents.where("doc_id % 10 = 0").select("doc_id").unionAll(t.labels.select("doc_id"))
    return t.documents.select("doc_id").join(allowed, "doc_id", "left_semi")


@query("SELECT user_id, bool_or(event_type = 'error' OR value < 10) AS any_failed, arg_min(event_type, event_id) FILTER (value < 10) AS first_error, count(*) AS gathered FROM events GROUP BY 1")
def rank_agreement(t: Tables) -> DataFrame:
    """Whether any rank failed, and the error of the lowest failing rank."""
    bad = F.col("value") < 10
    return t.events.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") | bad).alias("any_failed"), F.min_by("event_type", F.when(bad, F.col("event_id"))).alias("first_error"), F.count(F.lit(1)).alias("gathered"))


@query("SELECT doc_id, i FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 3 = 1 AND i BETWEEN 12 AND 200")
def range_of_interleaved_shard(t: Tables) -> DataFrame:
    """A row range read of one interleaved shard, from the files that overlap the range."""
    rows = read_row_range(t.spark, f"{t.sf_dir}/documents.parquet", 12, 201, ["doc_id"])
    return rows.select("doc_id", F.col("position").alias("i")).where("i % 3 = 1")
