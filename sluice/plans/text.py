"""Text and numeric functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import numeric as N
from sluice.functions import text as X
from sluice.plans.catalog import Tables, query


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ',', '|'), '|'), lambda x: trim(x, ' ')), lambda x: x <> ''), '/') AS paths FROM documents")
def path_list_parse(t: Tables) -> DataFrame:
    """A delimited list as paths."""
    listed = F.replace("text", F.lit(","), F.lit("|"))
    return t.documents.select("doc_id", F.array_join(X.path_list(F.concat(F.lit("|"), listed)), "/").alias("paths"))


_LEADS = ("In the video, ", "In this video clip, ", "Caption: ", "The clip captures ", "This picture presents ", "The animation highlights", "In the video, The clip shows ", "The Video shows ", "")


@query(r"""SELECT conv_id, turn, trim(regexp_replace(trim(lead || text, ' '), '^(In the video,|In this video,|In this video clip,|In the clip,|Caption:|(This video|The video|This clip|The clip|The animation|This image|The image|This picture|The picture) (shows|depicts|features|captures|highlights|introduces|presents))', ''), ' ') AS caption
FROM (SELECT *, ['In the video, ', 'In this video clip, ', 'Caption: ', 'The clip captures ', 'This picture presents ', 'The animation highlights', 'In the video, The clip shows ', 'The Video shows ', ''][turn % 9 + 1] AS lead FROM conversations)""")
def strip_llm_prefix(t: Tables) -> DataFrame:
    """One opening goes, the first that fits; a second one stays."""
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("turn") % len(_LEADS) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", X.strip_opening(F.concat(lead, "text")).alias("caption"))


@query(r"""SELECT conv_id, turn, CASE WHEN b = '' THEN p ELSE b END AS clean FROM (SELECT conv_id, turn, p, regexp_replace(p, '^[^\p{L}]+', '') AS b FROM (
  SELECT conv_id, turn, translate('12' || chr(8242) || ') ' || chr(8220) || text || chr(8221) || chr(8212) || chr(8722), chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8212) || chr(8211) || chr(160) || chr(8242) || chr(8722), '''''""-- ''-') AS p FROM conversations))""")
def clean_typography(t: Tables) -> DataFrame:
    dressed = F.concat(F.lit("12\u2032) \u201c"), F.col("text"), F.lit("\u201d\u2014\u2212"))
    return t.conversations.select("conv_id", "turn", X.clean_typography(dressed).alias("clean"))


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'turn ' || turn WHEN 1 THEN 'turn ' || turn WHEN 2 THEN 'cut ' || turn ELSE 'plain ' || turn END AS answer FROM conversations""")
def parse_model_response(t: Tables) -> DataFrame:
    """Four shapes of answers: JSON after thoughts, JSON inside text, cut-off JSON, plain text."""
    n = F.col("turn").cast("string")
    whole = F.concat(F.lit("<think>a {b}\nc</think> {\"caption\": \"turn "), n, F.lit("\"}"))
    inside = F.concat(F.lit("Sure: {\"caption\": \"turn "), n, F.lit("\"} done"))
    cut = F.concat(F.lit("{\"caption\": \"cut "), n)
    plain = F.concat(F.lit("thinking</think> plain "), n)
    shape = F.when(F.col("turn") % 4 == 0, whole).when(F.col("turn") % 4 == 1, inside).when(F.col("turn") % 4 == 2, cut).otherwise(plain)
    return t.conversations.select("conv_id", "turn", X.model_response(shape).alias("answer"))


@query(r"""SELECT page_id, CASE WHEN NOT (regexp_matches(s, '[/\\\x00-\x1f\x7f]') OR contains(s, '..')) THEN trim(regexp_replace(s, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') END AS id FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN replace(url, '/', ' ') ELSE page_id || '..x' END AS s FROM pages)""")
def safe_id(t: Tables) -> DataFrame:
    s = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("/"), F.lit(" "))).otherwise(F.concat(F.col("page_id"), F.lit("..x")))
    return t.pages.select("page_id", X.safe_id(s).alias("id"))


@query("SELECT page_id, left(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 40) || '_' || left(sha256(url), 12) AS dir FROM pages")
def safe_dir_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.safe_dir_name(F.col("url")).alias("dir"))


@query("SELECT event_id, props ->> '$.page' AS page, try_cast(props ->> '$.duration' AS DOUBLE) AS duration FROM events")
def embedded_json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.duration").try_cast("double").alias("duration"))


@query("""SELECT 'pages' AS dataset, page_id::VARCHAR AS record_id, url AS prompt, NULL::VARCHAR AS grp FROM pages
UNION ALL SELECT 'documents', doc_id::VARCHAR, text, lang FROM documents UNION ALL SELECT 'conversations', conv_id || '-' || turn, text, role FROM conversations""")
def three_schema_union(t: Tables) -> DataFrame:
    """Three source schemas as one record."""
    a = t.pages.select(F.lit("pages").alias("dataset"), F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("prompt"))
    b = t.documents.select(F.lit("documents").alias("dataset"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("prompt"), F.col("lang").alias("grp"))
    c = t.conversations.select(F.lit("conversations").alias("dataset"), F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.col("text").alias("prompt"), F.col("role").alias("grp"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c)


@query("SELECT page_id, regexp_matches(p, '^(/|[A-Za-z]:[\\\\/])') AS absolute, CASE WHEN regexp_matches(p, '^(/|[A-Za-z]:[\\\\/])') THEN p ELSE '/data/' || p END AS resolved FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/a/' || page_id WHEN 1 THEN 'C:/b/' || page_id ELSE 'c/' || page_id END AS p FROM pages)")
def path_resolution(t: Tables) -> DataFrame:
    n = F.col("page_id").cast("string")
    p = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/a/"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("C:/b/"), n)).otherwise(F.concat(F.lit("c/"), n))
    return t.pages.select("page_id", X.is_absolute(p).alias("absolute"), X.resolve_path("/data/", p).alias("resolved"))


@query("""SELECT p_partkey, ceil(w * greatest(832.0 / w, 480.0 / h))::BIGINT AS cover_w, round_even(w * least(832.0 / w, 480.0 / h), 0)::BIGINT AS fit_w, round_even(h * (640.0 / greatest(w, h)), 0)::BIGINT AS long_h,
  ((w + 31) // 32) * 32 AS up_w, ((h // 32) * 32)::BIGINT AS down_h, round(CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END, 6) AS srgb FROM (
  SELECT p_partkey, 100 + p_partkey % 1500 AS w, 90 + 17 * p_size AS h, p_size / 50.0::DOUBLE AS x FROM part)""")
def resize_geometry(t: Tables) -> DataFrame:
    """Cover, fit, long-side and aligned sizes, and a transfer curve."""
    rows = t.part.select("p_partkey", (100 + F.col("p_partkey") % 1500).alias("w"), (90 + 17 * F.col("p_size")).alias("h"), (F.col("p_size") / 50.0).alias("x"))
    w, h = F.col("w"), F.col("h")
    return rows.select("p_partkey", N.cover(w, h, 832, 480)[0].alias("cover_w"), N.fit(w, h, 832, 480)[0].alias("fit_w"), N.long_side(w, h, 640)[1].alias("long_h"), N.align_up(w, 32).alias("up_w"), N.align_down(h, 32).alias("down_h"), F.round(N.srgb(F.col("x")), 6).alias("srgb"))


@query("SELECT event_id, round(3.0 * value - 2.0 * (value / 2), 4) AS guided, round(greatest(0.0, least(100.0, value)) / 100.0 * 2 - 1, 6) AS ranged FROM events WHERE value IS NOT NULL")
def guidance_combination(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.where("value is not null").select("event_id", F.round(N.guided(v, v / 2, 3.0), 4).alias("guided"), F.round(N.map_range(v, 0.0, 100.0, -1.0, 1.0), 6).alias("ranged"))
