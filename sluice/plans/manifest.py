"""Manifest building over documents: reasons, keys, deduplication, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.identity import content_key
from sluice.operators.reject import blank, first_reason, with_reason
from sluice.plans.catalog import Tables, json_object, json_text, query

LONG, SHORT = 8_000, 40
TASKS = ("en", "fr", "de")


def checked(docs: DataFrame) -> DataFrame:
    """documents with the first failing check as reason."""
    return with_reason(
        docs,
        [
            ("empty_caption", blank("text")),
            ("caption_too_long", F.length("text") > LONG),
            ("caption_too_short", F.length("text") < SHORT),
            ("unsupported_task", ~F.col("lang").isin(*TASKS)),
        ],
    )


REASON_SQL = f"""CASE WHEN coalesce(trim(text), '') = '' THEN 'empty_caption' WHEN length(text) > {LONG} THEN 'caption_too_long'
    WHEN length(text) < {SHORT} THEN 'caption_too_short' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported_task' END"""


@query(f"""
WITH c AS (SELECT *, {REASON_SQL} AS reason, sha256({json_object(lang=json_text('lang'), text=json_text('text'))}) AS sample_key FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY doc_id) AS r FROM c WHERE reason IS NULL)
SELECT status, count(*) AS n, min(doc_id) AS first_doc FROM (
  SELECT CASE WHEN r = 1 THEN 'accepted' ELSE 'duplicate' END AS status, doc_id FROM k
  UNION ALL SELECT reason, doc_id FROM c WHERE reason IS NOT NULL) GROUP BY status
""")
def flagship_manifest_summary(t: Tables) -> DataFrame:
    """Scan, reject with reasons, key by content, first wins, count by status. One row per key meets in
    the aggregate, whose first id makes the accepted one; the first duplicate is the least id that is no key's first."""
    docs = t.documents.select("doc_id", "lang", "text")
    rows = checked(docs).withColumn("sample_key", content_key(docs, "lang", "text"))
    good = rows.where("reason is null").groupBy("sample_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    some = F.count(F.lit(1))
    totals = good.agg(some.alias("keys"), F.sum("n").alias("rows"), F.min("least").alias("first"))
    second = rows.where("reason is null").select("doc_id").join(good.select(F.col("least").alias("doc_id")), "doc_id", "left_anti").agg(F.min("doc_id").alias("second"))
    parts = F.explode(F.array(F.struct(F.lit("accepted").alias("status"), F.col("keys").alias("n"), F.col("first").alias("first_doc")), F.struct(F.lit("duplicate").alias("status"), (F.col("rows") - F.col("keys")).alias("n"), F.col("second").alias("first_doc"))))
    kept = totals.crossJoin(second).select(parts.alias("p")).select("p.*").where("n > 0")  # a row each
    rejected = rows.where("reason is not null").groupBy(F.col("reason").alias("status")).agg(some.alias("n"), F.min("doc_id").alias("first_doc"))
    return kept.unionAll(rejected)


@query(f"SELECT doc_id, {REASON_SQL} AS reason FROM documents")
def reject_reason_chain(t: Tables) -> DataFrame:
    return checked(t.documents).select("doc_id", "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def reject_reason_counts(t: Tables) -> DataFrame:
    return checked(t.documents).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 5")
def top_reject_reasons(t: Tables) -> DataFrame:
    return reject_reason_counts(t).orderBy(F.desc("n"), "reason").limit(5)


@query(f"""SELECT source, count(*) AS n_raw, count(*) FILTER (reason IS NULL) AS n_accepted, count(*) FILTER (reason IS NOT NULL) AS n_rejected,
  round(count(*) FILTER (reason IS NULL) / count(*), 6) AS accept_rate FROM (SELECT *, {REASON_SQL} AS reason FROM documents) GROUP BY source""")
def accept_rate_by_source(t: Tables) -> DataFrame:
    ok = F.count_if(F.col("reason").isNull())
    return checked(t.documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_raw"), ok.alias("n_accepted"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"), F.round(ok / F.count(F.lit(1)), 6).alias("accept_rate"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def task_dataset_counts_grouping_sets(t: Tables) -> DataFrame:
    t.documents.select("lang", "source", "n_chars").createOrReplaceTempView("_sluice_docs")
    return t.spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM _sluice_docs GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


@query("""SELECT f AS field, CASE WHEN f IN ('page_id', 'url', 'html') THEN false ELSE true END AS missing
FROM (SELECT unnest(['page_id', 'url', 'caption', 'html', 'references']) AS f)""")
def schema_preflight(t: Tables) -> DataFrame:
    """Required fields that the first row lacks, a row per field."""
    from sluice.operators.reject import preflight

    wanted = ["page_id", "url", "caption", "html", "references"]
    gone = set(preflight(t.pages, wanted))
    return t.spark.createDataFrame([(f, f in gone) for f in wanted], "field string, missing boolean")


@query("""SELECT l_orderkey, l_linenumber, CASE
  WHEN l_quantity < 3 THEN 'invalid_clip' WHEN l_extendedprice > 90000 THEN 'invalid_crop' WHEN l_discount = 0.05 AND l_tax = 0.08 THEN 'missing_reference' END AS reason FROM lineitem""")
def media_reason_chain(t: Tables) -> DataFrame:
    """Clip, crop and reference checks of a media record, on line items as stand-ins."""
    reason = first_reason([("invalid_clip", F.col("l_quantity") < 3), ("invalid_crop", F.col("l_extendedprice") > 90_000), ("missing_reference", (F.col("l_discount") == 0.05) & (F.col("l_tax") == 0.08))])
    return t.lineitem.select("l_orderkey", "l_linenumber", reason.alias("reason"))
