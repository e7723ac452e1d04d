"""Names, prompts, scalars and record projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import numeric as N
from sluice.functions import text as X
from sluice.operators.sampling import hash_order
from sluice.plans.catalog import Tables, query
from sluice.sources import adapters, discovery


@query("""SELECT conv_id, turn, CASE role WHEN 'system' THEN 'Rules: ' || text WHEN 'user' THEN 'Edit the image: ' || text ELSE 'Make a video: ' || text END AS prompt FROM conversations""")
def prompt_by_task(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.prompt(F.col("role"), {"system": "Rules: ", "user": "Edit the image: "}, "Make a video: ", F.col("text")).alias("prompt"))


@query("""SELECT p_partkey, j::INT AS bucket, (32 * (1 + j)) AS w, 64 AS h, (p_size * 8 + 1) AS f FROM (SELECT p_partkey, p_size, unnest(range(3)) AS j FROM part)""")
def bucket_string_parse(t: Tables) -> DataFrame:
    """Buckets written as WxHxF;WxHxF;..."""
    listed = F.concat_ws(";", *[F.format_string(f"{32 * (1 + j)}x64x%d", F.col("p_size") * 8 + 1) for j in range(3)])
    return t.part.select("p_partkey", F.posexplode(X.buckets(listed)).alias("bucket", "x")).select("p_partkey", "bucket", "x.*")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*/', ''), '\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*/', ''), '\.[^.]*$', '') || '_reference.png' AS reference FROM pages""")
def stem_and_reference_name(t: Tables) -> DataFrame:
    stem = X.stem(F.substring_index(F.substring_index("url", "?", 1), "#", 1))
    return t.pages.select("page_id", stem.alias("stem"), F.concat(stem, F.lit("_reference.png")).alias("reference"))


@query("""SELECT p_partkey, split_part(p_type || '_' || p_size, '_', 1) AS prefix, len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS parts, printf('%.1f%%', 100.0 * p_size / 50) AS pct, printf('%02d:%02d:%02d', p_size * 97 // 3600, p_size * 97 % 3600 // 60, p_size * 97 % 60) AS eta FROM part""")
def names_and_formats(t: Tables) -> DataFrame:
    """An id's prefix, items of a list, a share as text, a span as HH:MM:SS."""
    items = X.comma_list(F.replace("p_name", F.lit(" "), F.lit(" , ")))
    return t.part.select("p_partkey", F.substring_index(F.concat_ws("_", "p_type", "p_size"), "_", 1).alias("prefix"), F.size(items).alias("parts"), F.format_string("%.1f%%", 100.0 * F.col("p_size") / 50).alias("pct"), X.clock(F.col("p_size") * 97).alias("eta"))


@query("""SELECT source, CASE WHEN n = 0 THEN 'r2v' WHEN n = 1 THEN 'i2i' ELSE 'i2i,r2v' END AS tasks FROM (SELECT DISTINCT source, ascii(right(source, 1)) % 3 AS n FROM documents)""")
def task_list_parse(t: Tables) -> DataFrame:
    """Task lists in any case and order, as canonical lists."""
    wanted = {i: ",".join(discovery.parse_tasks(s)) for i, s in enumerate((" R2V,", "i2i", "R2V, I2I,r2v"))}
    kind = F.ascii(F.substring("source", -1, 1)) % 3
    return t.documents.select("source", reduce(lambda c, i: c.when(kind == i, wanted[i]), (1, 2), F.when(kind == 0, wanted[0])).alias("tasks")).distinct()


@query("""SELECT p_partkey, w % 16 = 0 AND h % 16 = 0 AS divides, ((w - cw) // 2)::BIGINT AS x, ((h - ch) // 2)::BIGINT AS y, cw::BIGINT AS cw, ch::BIGINT AS ch FROM (
  SELECT *, CASE WHEN w / h::DOUBLE > 1.5 THEN round_even(h * 1.5, 0)::BIGINT ELSE w END AS cw, CASE WHEN w / h::DOUBLE > 1.5 THEN h ELSE round_even(w / 1.5, 0)::BIGINT END AS ch FROM (SELECT p_partkey, 24 * (1 + p_partkey % 30) AS w, 16 * p_size AS h FROM part))""")
def centre_crop_and_divisibility(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (24 * (1 + F.col("p_partkey") % 30)).alias("w"), (16 * F.col("p_size")).alias("h"))
    x, y, cw, ch = N.centre_crop(F.col("w"), F.col("h"), 1.5)
    return rows.select("p_partkey", ((F.col("w") % 16 == 0) & (F.col("h") % 16 == 0)).alias("divides"), x.alias("x"), y.alias("y"), cw.alias("cw"), ch.alias("ch"))


@query("""WITH s AS (SELECT p_partkey, 64 * (1 + p_partkey % 30) AS w, 48 * p_size AS h FROM part), z AS (SELECT *, greatest(832.0::DOUBLE / w, 480.0::DOUBLE / h) AS k FROM s), d AS (SELECT *, greatest(832, round_even(w * k, 0))::BIGINT AS sw, greatest(480, round_even(h * k, 0))::BIGINT AS sh FROM z)
SELECT p_partkey, sw, sh, (sh - 480) // 2 AS top, (sw - 832) // 2 AS "left", round(832.0 * 480 / (sw * sh), 6)::DOUBLE AS retained, 832.0 * 480 / (sw * sh) < 0.7 AS severe, sh > 480 AS vertical, sw > 832 AS horizontal, abs(w / h::DOUBLE - 1.0) <= 0.05 AS square_to_wide, w < h AS portrait_to_wide FROM d""")
def crop_risk_flags(t: Tables) -> DataFrame:
    """Geometry and the five risks of covering 832 x 480 by a centred crop."""
    rows = t.part.select("p_partkey", (64 * (1 + F.col("p_partkey") % 30)).alias("w"), (48 * F.col("p_size")).alias("h"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in N.crop_risks(F.col("w"), F.col("h"), 832, 480).items()])


@query("""SELECT event_id, to_json({'a': 1, 'user': user_id, 'x': 'new'})::VARCHAR AS merged FROM events""")
def map_override(t: Tables) -> DataFrame:
    """Two maps merged: the right one wins, the left one's place stays."""
    left = F.create_map(F.lit("a"), F.lit("1"), F.lit("user"), F.col("user_id").cast("string"), F.lit("x"), F.lit("old"))
    right = F.create_map(F.lit("x"), F.lit("new"))
    merged = X.merge_maps(left, right)
    return t.events.select("event_id", F.to_json(F.struct(merged["a"].cast("int").alias("a"), merged["user"].cast("long").alias("user"), merged["x"].alias("x"))).alias("merged"))


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS steps FROM (SELECT p_partkey, list(x ORDER BY f) AS list_distinct_ordered FROM (SELECT p_partkey, x, min(i) AS f FROM (SELECT p_partkey, i, (i * p_size // 20)::INT AS x FROM (SELECT p_partkey, p_size, unnest(range(12)) AS i FROM part)) GROUP BY ALL) GROUP BY 1)""")
def schedule_distinct(t: Tables) -> DataFrame:
    """Timesteps of a schedule without repeats, in order."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor(i * F.col("p_size") / 20).cast("int"))
    return t.part.select("p_partkey", F.array_join(F.array_distinct(steps).cast("array<string>"), ",").alias("steps"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'out/elsewhere/' || page_id || '.pt' ELSE 'out/' || page_id || '.pt' END AS target FROM pages""")
def output_key(t: Tables) -> DataFrame:
    """Outputs mirror inputs below their root; those outside keep their whole path. The suffix changes."""
    path = F.concat(F.when(F.col("page_id") % 4 == 0, "/elsewhere/").otherwise("/data/"), "page_id", F.lit(".mp4"))
    return t.pages.select("page_id", X.output_path(path, "/data", "out", ".pt").alias("target"))


@query("""SELECT doc_id, array_to_string(['r0.png', 'r1.png', 'r2.png', 'r3.png', 'r4.png'][1:least(3, n_chars % 6)], ',') AS refs FROM documents""")
def sample_projection(t: Tables) -> DataFrame:
    """A sample's references, cut to three."""
    refs = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("r"), i.cast("string"), F.lit(".png")))
    mine = F.slice(refs, 1, (F.col("n_chars") % 6).cast("int"))
    return t.documents.select("doc_id", F.array_join(F.slice(mine, 1, 3), ",").alias("refs"))


@query("""SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'ref/' || doc_id || '.png' ELSE 'old/' || doc_id END AS reference FROM documents""")
def reference_column_replace(t: Tables) -> DataFrame:
    """A reference column set for some rows and left for others."""
    rows = t.documents.select("doc_id", "lang", F.concat(F.lit("old/"), "doc_id").alias("reference"))
    return rows.withColumn("reference", F.when(F.col("lang") == "en", F.format_string("ref/%d.png", "doc_id")).otherwise(F.col("reference")))


@query("""SELECT doc_id, replace(replace('model.' || source || '.weight', 'model.', 'net.'), 'src', 'block') AS key FROM documents WHERE starts_with('model.' || source || '.weight', 'model.') AND contains(source, 'src1')""")
def key_rewrite(t: Tables) -> DataFrame:
    """Keys by prefix and content, rewritten by replacements in order."""
    key = F.concat(F.lit("model."), "source", F.lit(".weight"))
    return t.documents.where(key.startswith("model.") & key.contains("src1")).select("doc_id", adapters.rewrite_keys(key, [("model.", "net."), ("src", "block")]).alias("key"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'key0' ELSE 'value' END || suffix AS key FROM part, (SELECT unnest(['.a', '.b']) AS suffix) WHERE p_partkey % 3 > 0 OR suffix = '.a'""")
def state_key_operations(t: Tables) -> DataFrame:
    """Operations that turn one key into none, one or several."""
    out = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("key0.a"))).otherwise(F.array(F.lit("value.a"), F.lit("value.b")))
    return t.part.select("p_partkey", F.explode(out).alias("key"))


@query("""SELECT conv_id, turn, round((turn + 1) * 2.0 - 3.0, 4)::DOUBLE AS x, role = 'user' AS held FROM conversations WHERE role <> 'system'""")
def folded_conditions(t: Tables) -> DataFrame:
    """Condition items applied one after another to a state."""
    items = [
        lambda d: d.where("role <> 'system'"),
        lambda d: d.withColumn("x", F.col("turn") + 1),
        lambda d: d.withColumn("x", F.round(F.col("x") * 2.0 - 3.0, 4)),
        lambda d: d.withColumn("held", F.col("role") == "user"),
    ]
    return reduce(lambda d, item: d.transform(item), items, t.conversations.select("conv_id", "turn", "role")).drop("role")


@query("""SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'target_unreadable' WHEN n_chars % 3 = 0 THEN 'reference_unreadable' END AS reason FROM documents""")
def deferred_finalize(t: Tables) -> DataFrame:
    """References are looked at only in rows that stand all other checks."""
    first = t.documents.select("doc_id", "n_chars", F.when(F.col("n_chars") % 4 == 0, "target_unreadable").alias("reason"))
    later = F.when(F.col("n_chars") % 3 == 0, "reference_unreadable")
    return first.select("doc_id", F.coalesce("reason", later).alias("reason"))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('bundle:' || doc_id), doc_id) AS r FROM documents WHERE lang IN ('en', 'fr')) WHERE r <= 5""")
def bundle_read(t: Tables) -> DataFrame:
    """A bundle's samples of wanted tasks, five of each."""
    from sluice.operators.sampling import first_k

    rows = t.documents.where(F.col("lang").isin("en", "fr")).select("lang", "doc_id").withColumn("h", hash_order("bundle", "doc_id"))
    return first_k(rows, ["lang"], ["h", "doc_id"], 5).select("lang", "doc_id")
