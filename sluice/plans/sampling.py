"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.numeric import linear_shift
from sluice.functions.quantiles import logit_normal_draw, normal_quantile_sql
from sluice.operators.epochs import epoch_slots
from sluice.operators.identity import with_row_index
from sluice.operators.sampling import apportion, draw_category, exact_share, first_k, hash_order, stratified, unit
from sluice.plans.catalog import Tables, query
from sluice.sources.offsets import read_row_range


_UNIT = "(('0x' || left(sha256('{}:' || doc_id), 13))::BIGINT / 4503599627370496.0)"


@query("""SELECT doc_id, CASE WHEN d < 0.3 THEN 'i2i' WHEN d < 0.3 + 0.5 THEN 'r2v' ELSE 'both' END AS category FROM (
  SELECT doc_id, ('0x' || left(sha256('seed:' || doc_id), 13))::BIGINT / 4503599627370496.0 AS d FROM documents)""")
def category_draw(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", draw_category(unit("seed", "doc_id"), [("i2i", 0.3), ("r2v", 0.5), ("both", 0.2)]).alias("category"))


@query("""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_sort(list_transform(range(len(w)), lambda i: {'h': sha256(concat_ws('|', doc_id::VARCHAR, '17', i::VARCHAR, w[i + 1])), 'i': i, 'x': w[i + 1]}))[1:3], lambda s: {'i': s.i, 'x': s.x})), lambda s: s.x), ' ') AS picked
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def seeded_array_topk(t: Tables) -> DataFrame:
    """Three of a row's words by hashed score, in their order."""
    words = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    scored = F.transform("w", lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("17"), i.cast("string"), x), 256).alias("h"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(scored), 1, 3)
    again = F.array_sort(F.transform(best, lambda s: F.struct(s.i.alias("i"), s.x.alias("x"))))
    return words.select("doc_id", F.array_join(F.transform(again, lambda s: s.x), " ").alias("picked"))


@query("""SELECT lang, doc_id, r::INT AS pick FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('walk:' || doc_id), doc_id) AS r FROM documents WHERE n_chars > 100) WHERE r <= 4""")
def walk_order_first_k(t: Tables) -> DataFrame:
    rows = t.documents.where("n_chars > 100").select("lang", "doc_id").withColumn("h", hash_order("walk", "doc_id"))
    few = first_k(rows, ["lang"], ["h", "doc_id"], 4)
    return few.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")).alias("pick"))


@query("""WITH c AS (SELECT lang, doc_id, 1 + n_chars % 5 AS refs, row_number() OVER (PARTITION BY lang ORDER BY sha256('strat:' || doc_id), doc_id) AS walk FROM documents),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY walk) AS seen FROM c WHERE refs <= 4),
f AS (SELECT *, min(seen) OVER (PARTITION BY lang, refs) AS fs FROM v),
d AS (SELECT *, sum(CASE WHEN seen = fs THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY seen) AS kinds FROM f),
s AS (SELECT *, min(CASE WHEN kinds >= 4 AND least(seen, 12) >= 6 THEN seen END) OVER (PARTITION BY lang) AS stop FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN seen = fs THEN refs ELSE 5 END, walk) AS pick FROM s WHERE stop IS NULL OR seen <= stop)
SELECT lang, doc_id, refs, pick::INT AS pick FROM p WHERE pick <= 6""")
def stratified_select(t: Tables) -> DataFrame:
    """Six of each language: one of each reference count 1..4 first, then the walk."""
    walk = F.concat_ws(":", hash_order("strat", "doc_id"), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    rows = t.documents.select("lang", "doc_id", (1 + F.col("n_chars") % 5).alias("refs"), walk.alias("walk"))
    return stratified(rows, ["lang"], "refs", "walk", 6).select("lang", "doc_id", "refs", "pick")


@query("""SELECT event_id AS step, CASE WHEN row_number() OVER (ORDER BY sha256('steps:' || event_id), event_id) <= round_even(count(*) OVER () * 0.3, 0) THEN 'i2i' ELSE 'r2v' END AS task FROM events""")
def ratio_schedule(t: Tables) -> DataFrame:
    """A step per event, exactly 30 % of them of the first task, in hashed order."""
    steps = t.events.select(F.col("event_id").alias("step")).withColumn("h", F.sha2(F.concat(F.lit("steps:"), F.col("step").cast("string")), 256))
    return exact_share(steps, ["h", "step"], 0.3).select("step", F.when(F.col("chosen"), "i2i").otherwise("r2v").alias("task"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT source, n, n * 10007.0 / (SELECT sum(n) FROM c) AS x FROM c),
f AS (SELECT *, floor(x)::BIGINT AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS r FROM e)
SELECT source, n, fl + CASE WHEN r <= 10007 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f""")
def largest_remainder(t: Tables) -> DataFrame:
    """10,007 steps dealt over sources by size."""
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return apportion(sizes, "n", "source", 10_007).select("source", "n", "quota")


BLOCK = 16


def _epochs(t: Tables) -> DataFrame:
    """Slots of every language's documents, in blocks of 16, over three and a half epochs."""
    sizes = t.documents.groupBy(F.col("lang").alias("task")).agg(F.count(F.lit(1)).alias("size"))
    return epoch_slots(sizes.withColumn("steps", F.ceil(F.col("size") * 3.5 / BLOCK)), BLOCK, "epochs")


@query()
def epoch_stream_blocks(t: Tables) -> DataFrame:
    """Block-unique epochs of every language; their invariants are the next query and tests, as SQL has no such walk."""
    return _epochs(t)


@query(f"""WITH s AS (SELECT lang AS task, count(*) AS n, ceil(count(*) * 3.5 / {BLOCK})::BIGINT AS steps FROM documents GROUP BY 1),
e AS (SELECT task, n, steps, unnest(range(ceil(steps * {BLOCK} / n)::BIGINT)) AS epoch FROM s)
SELECT task, epoch, least(n, steps * {BLOCK} - epoch * n) AS slots, least(n, steps * {BLOCK} - epoch * n) AS distinct_rows, CASE WHEN n >= {BLOCK} THEN 0 END AS repeats_in_blocks FROM e""")
def epoch_stream_invariants(t: Tables) -> DataFrame:
    """Of every epoch: its slots, its different rows, and how many slots repeat a row of their block."""
    slots = _epochs(t)
    n = t.documents.groupBy(F.col("lang").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    rows = slots.join(F.broadcast(n), "task").withColumn("epoch", F.floor((F.col("step") * BLOCK + F.col("slot")) / F.col("n")))  # a row per language
    in_block = rows.groupBy("task", "step", "row_index").agg(F.count(F.lit(1)).alias("c"), F.min("epoch").alias("epoch")).groupBy("task", "epoch").agg(F.sum(F.col("c") - 1).alias("repeats"))
    per_row = rows.groupBy("task", "epoch", "row_index").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    epochs = per_row.groupBy("task", "epoch").agg(F.sum("c").alias("slots"), F.count(F.lit(1)).alias("distinct_rows"), F.first("n").alias("n"))
    return epochs.join(in_block, ["task", "epoch"], "left").select("task", "epoch", "slots", "distinct_rows", F.when(F.col("n") >= BLOCK, F.coalesce("repeats", F.lit(0))).cast("int").alias("repeats_in_blocks"))


@query("""SELECT vec_id, i::INT AS i, x FROM (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY sha256('keep:' || vec_id || ':' || i), i) AS r FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings)) WHERE r <= 16""")
def keep_mask_topk_per_group(t: Tables) -> DataFrame:
    """Exactly 16 of each vector's places, by hashed score."""
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rows = rows.select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"), hash_order("keep", "vec_id", "i").alias("h"))
    return first_k(rows, ["vec_id"], ["h", "i"], 16).select("vec_id", "i", "x")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'system'), (role <> 'user') , turn DESC) AS gone, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn DESC) AS removal FROM conversations) WHERE removal > n - 4 OR role = 'system'""")
def priority_truncation(t: Tables) -> DataFrame:
    """At most four turns: assistant turns go first, from the tail, then user turns; system stays."""
    w = Window.partitionBy("conv_id")
    section = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    removal = F.row_number().over(w.orderBy(section, F.desc("turn")))
    rows = t.conversations.select("conv_id", "turn", "role", removal.alias("removal"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where((F.col("removal") > F.col("n") - 4) | (F.col("role") == "system")).select("conv_id", "turn", "role")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def dataset_cap(t: Tables) -> DataFrame:
    """At most ten samples of each dataset."""
    return first_k(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], 10)


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def offset_limit(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20)


@query("SELECT doc_id, i // 8 AS step, i % 8 // 4 AS microstep, i % 4 AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('slots:' || doc_id), doc_id) - 1 AS i FROM documents)")
def rank_slots(t: Tables) -> DataFrame:
    """The step, microstep and rank that take each document, two microsteps of four ranks a step, in hashed order."""
    rows = with_row_index(t.documents.select("doc_id", hash_order("slots", "doc_id").alias("h")), ["h", "doc_id"], "i")
    return rows.select("doc_id", F.floor(F.col("i") / 8).alias("step"), F.floor(F.col("i") % 8 / 4).alias("microstep"), (F.col("i") % 4).alias("rank"))


@query(f"""SELECT doc_id, round(u, 9) AS u, round(CASE WHEN w > 0.1 THEN least(1.0, greatest(0.0, CASE WHEN raw >= 0.001 THEN raw ELSE 0.002 - raw END)) ELSE 0.999 * o + 0.001 END, 7) AS timestep
FROM (SELECT *, (1 / (1 + exp(-({normal_quantile_sql('u')} + mu))) - 1 / (1 + exp(-(mu - 2.5758)))) / (1 / (1 + exp(-(mu + 3.0902))) - 1 / (1 + exp(-(mu - 2.5758)))) AS raw
FROM (SELECT doc_id, 0.95 + 1.1 / 3072 * (n_chars - 1024) AS mu, greatest({_UNIT.format('step')}, 1e-12) AS u, {_UNIT.format('flat')} AS o, {_UNIT.format('mix')} AS w FROM documents))""")
def logit_normal_draws(t: Tables) -> DataFrame:
    """A timestep of each document: shifted by its length, stretched, reflected, and uniform for a tenth of them."""
    docs = t.documents.select("doc_id", linear_shift(F.col("n_chars"), (1024, 0.95), (4096, 2.05)).alias("mu"), F.greatest(unit("step", "doc_id"), F.lit(1e-12)).alias("u"), unit("flat", "doc_id").alias("o"), unit("mix", "doc_id").alias("w"))
    return docs.select("doc_id", F.round("u", 9).alias("u"), F.round(logit_normal_draw(F.col("u"), F.col("o"), F.col("w"), F.col("mu")), 7).alias("timestep"))


@query("SELECT doc_id, i FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i BETWEEN 25 AND 60")
def row_range_scan(t: Tables) -> DataFrame:
    """Rows of a range of positions: the table's files hold them in order of doc_id, so only the files that
    overlap the range are read."""
    return read_row_range(t.spark, f"{t.sf_dir}/documents.parquet", 25, 61, ["doc_id"]).select("doc_id", F.col("position").alias("i"))
