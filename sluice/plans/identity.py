"""Keys, deduplication, collisions, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.identity import collisions, content_key, dedup, external_key, with_row_index
from sluice.plans.catalog import Tables, json_object, json_text, query


_NUMBER = "coalesce(n_chars::VARCHAR, 'null')"
_PLAN = f"sha256({json_object(lang=json_text('lang'), n_chars=_NUMBER, source=json_text('source'))})"


@query(f"SELECT doc_id, sha256({json_object(lang=json_text('lang'), n_chars=_NUMBER, source=json_text('source'), text=json_text('text'))}) AS sample_key FROM documents")
def sample_key(t: Tables) -> DataFrame:
    docs = t.documents
    return docs.select("doc_id", content_key(docs, "source", "lang", "text", "n_chars").alias("sample_key"))


@query(f"""SELECT doc_id, plan_hash, plan_hash = {_PLAN} AS valid FROM (
  SELECT doc_id, source, lang, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, {_PLAN} AS plan_hash FROM documents)""")
def plan_hash_verify(t: Tables) -> DataFrame:
    """A stored hash against one recomputed after every tenth row was changed."""
    docs = t.documents
    stored = docs.withColumn("plan_hash", content_key(docs, "source", "lang", "n_chars"))
    changed = stored.withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return changed.select("doc_id", "plan_hash", (F.col("plan_hash") == content_key(changed, "source", "lang", "n_chars")).alias("valid"))


@query(f"""SELECT conv_id, sha256({json_object(n="n::VARCHAR", roles="roles", turns="'{' || entries || '}'")}) AS conversation_key FROM (
  SELECT conv_id, count(*) AS n, '[' || string_agg({json_text('role')}, ',' ORDER BY turn, role) || ']' AS roles, string_agg('"' || turn || '":' || {json_text('text')}, ',' ORDER BY turn::VARCHAR) AS entries
  FROM conversations GROUP BY conv_id)""")
def nested_content_key(t: Tables) -> DataFrame:
    """A key over a nested record: a list of roles in order, and a map from turn to text, sorted by the turns' text."""
    turns = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    rows = turns.select("conv_id", "n", F.col("r.role").alias("roles"), "turns")
    return rows.select("conv_id", content_key(rows, "n", "roles", "turns").alias("conversation_key"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_wins(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    return dedup(rows, ["key"], ["doc_id"]).drop("key")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1 ORDER BY text")
def dedup_last_wins(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    return dedup(rows, ["key"], ["doc_id"], last=True).orderBy("key").drop("key")


@query("SELECT lang, source, left(text, 8) AS head, count(*) AS n_rows, count(DISTINCT text) AS n_plans FROM documents GROUP BY 1, 2, 3 HAVING count(DISTINCT text) > 1")
def key_collision_report(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source", F.substring("text", 1, 8).alias("head"), F.sha2("text", 256).alias("plan"))
    return collisions(rows, ["lang", "source", "head"], F.col("plan"))


@query("""SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') AS kinds FROM (
  SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY user_id""")
def array_ordered_distinct(t: Tables) -> DataFrame:
    """Each user's event types in order of first appearance."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join(F.array_distinct("x.event_type"), ",").alias("kinds"))


@query("SELECT page_id, sha256('pages' || chr(0) || url) AS external_key FROM pages")
def external_record_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", external_key(F.lit("pages"), F.col("url")).alias("external_key"))


@query("""SELECT row_number() OVER (ORDER BY dataset_order, id) - 1 AS task_row, dataset_order, id, name FROM (
  SELECT 0 AS dataset_order, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)""")
def task_row_index(t: Tables) -> DataFrame:
    """Positions over sources in the order of the configuration."""
    one = t.part.select(F.lit(0).alias("dataset_order"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    two = t.supplier.select(F.lit(1).alias("dataset_order"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return with_row_index(one.unionByName(two), ["dataset_order", "id"], "task_row").select("task_row", "dataset_order", "id", "name")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").distinct().join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("SELECT conv_id, CASE WHEN r = 1 THEN 'c' || conv_id ELSE (i - 1)::VARCHAR END AS source_record_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations)")
def row_id_resolution(t: Tables) -> DataFrame:
    """An explicit id where a row has one (first turns), else its position."""
    from sluice.sources.annotations import row_id

    least = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("least"))
    rows = with_row_index(t.conversations.select("conv_id", "turn"), ["conv_id", "turn"]).join(least, "conv_id")
    rows = rows.withColumn("source_record_id", F.when(F.col("turn") == F.col("least"), F.concat(F.lit("c"), F.col("conv_id"))).otherwise(F.lit(" ")))
    return rows.select("conv_id", row_id(F.col("row_index"), rows.columns).alias("source_record_id"), "turn")
