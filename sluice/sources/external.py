"""Evaluation sets from outside: their JSON files to normalised records, and normalised manifests read back under full checks.

A record that cannot be taken becomes a row with a ``problem``; nothing else of its file is lost. Normalised records of one set
must have record ids and output ids of their own; those that do not are reported as a row per id.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import is_absolute, normal_path, output_id, output_id_problem, stem_of_name, stripped
from sluice.operators.identity import dedup, external_key
from sluice.operators.publish import PathPolicy
from sluice.operators.reject import first_reason
from sluice.operators.validate import FPS, FRAMES, HEIGHT, WIDTH
from sluice.session import dealt, kept
from sluice.sources.annotations import numbered_lines

VERSION = 1


@dataclass(frozen=True)
class Layout:
    """How a set's JSON is laid out: an object keyed by record id, or a list; the fields of its records; whether references must be
    absolute (else they lie beside the file); whether the id is a file name whose stem counts."""

    references: str
    caption: str
    id: str | None = None
    absolute: bool = True
    named_by_file: bool = False
    metadata: tuple[str, ...] = field(default=())


#: The known sets and their fields.
LAYOUTS = {
    "videoxfun_test": Layout("ref_images", "prompt", "id"),
    "custom64": Layout("ref_image_paths", "caption", "video_name", named_by_file=True, metadata=("video_name",)),
    "opens2v_open_domain": Layout("img_paths", "prompt", absolute=False, metadata=("synthesis_flag", "class_label")),
}


def read_external(spark: SparkSession, path: str, dataset: str, policy: PathPolicy | None = None) -> DataFrame:
    """Records of a set's JSON file as (source_index, raw): its key in an object (of a repeated one the last record counts), its place
    in a list. A path outside ``policy`` is refused before it is opened, as is a file that is not laid out as ``dataset`` is.

    A JSON document is one record of a text reader, so it is read by one task; sets of many records belong into many files."""
    layout = LAYOUTS[dataset]
    if policy:
        policy.check(path)
    whole = spark.read.text(path, wholetext=True)
    kind, opening = ("array<string>", "[") if layout.id else ("map<string,string>", "{")
    parsed = F.from_json("value", kind)
    bad = whole.where(~F.coalesce(F.ltrim("value").startswith(opening) & parsed.isNotNull(), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"{dataset} needs JSON {'lists' if layout.id else 'objects keyed by record id'}: {path}")
    if layout.id:
        return whole.select(F.posexplode(parsed).alias("_at", "raw")).select(F.col("_at").cast("string").alias("source_index"), "raw")
    rows = whole.select(F.posexplode(parsed).alias("_at", "source_index", "raw"))
    return dedup(rows, ["source_index"], ["_at"], last=True).drop("_at")


def _resolved(value: Column, folder: str) -> Column:
    """A path as it is opened: normal, below the file's folder if it is relative; a Windows path stays as it is."""
    return F.when(value.startswith("/"), normal_path(value)).when(is_absolute(value), value).otherwise(normal_path(F.concat(F.lit(folder.rstrip("/") + "/"), value)))


def normalize_external(rows: DataFrame, dataset: str, source_json: str) -> DataFrame:
    """Normalised records of (source_index, raw), a row each, with the first ``problem`` of those that cannot be taken.

    Checks in order: the record is an object; its id (or plain file name); its caption; its references (a list of one to four, not
    empty, absolute where they must be); a safe output id. Null fields count as missing. A rejected row keeps its source_index and
    whatever id could be read; its other columns are null. Records are dealt over tasks by their number, and their normalised rows are
    kept: filters on ``problem`` would repeat all of its checks."""
    layout = LAYOUTS[dataset]
    folder = posixpath.dirname(source_json)
    text = lambda name: stripped(F.coalesce(F.try_element_at("_r", F.lit(name)), F.lit("")))
    parsed = F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", "map<string,string>"))
    r = dealt(rows).withColumn("_r", parsed)
    r = r.withColumn("_name", text(layout.id) if layout.id else stripped(F.col("source_index")))
    r = r.withColumns({"_id": stem_of_name(F.col("_name")) if layout.named_by_file else F.col("_name"), "_caption": text(layout.caption), "_list": F.try_element_at("_r", F.lit(layout.references))})
    refs = F.when(F.ltrim("_list").startswith("["), F.from_json("_list", "array<string>"))
    r = r.withColumn("_refs", F.transform(refs, lambda x: F.coalesce(x, F.lit(""))))
    empty, relative = (lambda x: stripped(x) == ""), (lambda x: ~is_absolute(x))
    # of a list with several bad references the first one names the problem
    which = F.filter(F.transform("_refs", lambda x: F.when(empty(x), "empty_reference").when(F.lit(layout.absolute) & relative(x), "reference_not_absolute")), lambda x: x.isNotNull())
    plain = (F.col("_name") == ".") | F.col("_name").contains("/") | F.col("_name").contains("..")
    problem = F.coalesce(
        first_reason(
            [
                ("not_an_object", F.col("_r").isNull()),
                ("missing_id", F.col("_name") == ""),
                ("not_a_plain_filename", F.lit(layout.named_by_file) & plain),
                ("empty_caption", F.col("_caption") == ""),
                ("references_not_a_list", F.col("_refs").isNull()),
                ("reference_count_out_of_range", ~F.size("_refs").between(1, 4)),
            ]
        ),
        F.get(which, 0),
        output_id_problem(F.col("_id")),
    )
    r = r.withColumn("problem", problem)
    good = lambda c: F.when(F.col("problem").isNull(), c)
    extra = [x for name in layout.metadata for x in (F.lit(name), F.try_element_at("_r", F.lit(name)))]
    if not layout.id:
        extra += [F.lit("schema_group"), F.substring_index("_id", "_", 1)]
    metadata = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    out = r.select(
        "source_index",
        "problem",
        good(F.lit(VERSION)).alias("schema_version"),
        good(F.lit(dataset)).alias("dataset_name"),
        good(F.lit(source_json)).alias("source_json"),
        F.when(F.col("_id") != "", F.col("_id")).alias("source_record_id"),
        good(output_id(F.col("_id"))).alias("output_id"),
        good(external_key(F.lit(dataset), F.col("_id"))).alias("sample_key"),
        good(F.lit("r2v")).alias("task"),
        good(F.col("_caption")).alias("caption"),
        good(F.transform("_refs", lambda x: _resolved(x, folder))).alias("reference_paths"),
        good(F.col("_refs")).alias("original_reference_paths"),
        *[good(F.lit(v)).alias(n) for n, v in (("width", WIDTH), ("height", HEIGHT), ("num_frames", FRAMES), ("fps", FPS))],
        good(metadata).alias("dataset_metadata"),
    )
    return kept(out, "normalised")


def external_errors(normalized: DataFrame) -> DataFrame:
    """Everything against a normalised set: (source_index, error_type, problem, n). Rejected records count 1; a record id that several
    accepted records have, or an output id that several take, is one row with their number. Ids are pre-aggregated before they meet."""
    rejected = normalized.where("problem is not null").select("source_index", F.lit("record").alias("error_type"), "problem", F.lit(1).cast("long").alias("n"))
    taken = normalized.where("problem is null")
    out = rejected
    for name, kind in (("source_record_id", "duplicate_source_id"), ("output_id", "output_id_collision")):
        many = taken.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionAll(many.select(F.col(name), F.lit(kind), F.col(name), "n"))
    return out


#: A normalised record as its manifest holds it. Numbers are read as text, so that ``1`` and ``1.0`` are the same.
MANIFEST = "schema_version string, dataset_name string, source_json string, source_record_id string, output_id string, sample_key string, task string, caption string, reference_paths array<string>, original_reference_paths array<string>, width string, height string, num_frames string, fps string, dataset_metadata map<string,string>"


def record_reason(df: DataFrame) -> Column:
    """Why a normalised record is not valid; null if it is. All values are recomputed from the record's own: output id, geometry, key.

    Checks in order: fields there, version and task, set, absolute file, output id canonical and that of its record id, caption and
    one to four references, absolute references, as many originals, geometry, key."""
    names = [part.split()[0] for part in MANIFEST.split(", ")]
    if not set(names) <= set(df.columns):
        return F.lit("missing_field")
    every = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    same = lambda c, value: F.coalesce(F.col(c).try_cast("double") == value, F.lit(False))
    canonical = F.coalesce(output_id_problem(F.col("output_id")).isNull() & (output_id(F.col("output_id")) == F.col("output_id")), F.lit(False))
    own = F.coalesce(output_id_problem(F.col("source_record_id")).isNull() & (output_id(F.col("source_record_id")) == F.col("output_id")), F.lit(False))
    return first_reason(
        [
            ("missing_field", ~every),
            ("schema_version_or_task", ~same("schema_version", VERSION) | (F.col("task") != "r2v")),
            ("unknown_dataset", ~F.col("dataset_name").isin(*LAYOUTS)),
            ("source_json_not_absolute", ~F.col("source_json").startswith("/")),
            ("output_id_not_canonical", ~canonical),
            ("output_id_mismatch", ~own),
            ("caption_or_references", (stripped(F.col("caption")) == "") | ~F.size("reference_paths").between(1, 4)),
            ("reference_not_absolute", ~F.forall("reference_paths", lambda x: F.coalesce(is_absolute(x), F.lit(False)))),
            ("reference_counts_differ", F.size("original_reference_paths") != F.size("reference_paths")),
            ("geometry_mismatch", ~(same("width", WIDTH) & same("height", HEIGHT) & same("num_frames", FRAMES) & same("fps", FPS))),
            ("sample_key_mismatch", F.col("sample_key") != external_key(F.col("dataset_name"), F.col("source_record_id"))),
        ]
    )


def check_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a normalised manifest that is not blank: line_number (blank ones count), its fields, and its ``problem``."""
    lines = numbered_lines(spark, path).where(stripped(F.col("raw")) != "")
    read = lines.select("line_number", "raw", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", MANIFEST)).alias("r"))
    flat = read.select("line_number", "raw", F.col("r").isNull().alias("_bad"), "r.*")
    broken = F.col("_bad") | F.try_parse_json("raw").isNull()
    return flat.withColumn("problem", F.when(broken, F.lit("not_json")).otherwise(record_reason(flat))).drop("_bad", "raw")


def load_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Records of a normalised manifest. The first line with a problem, an empty manifest, and an output id that comes twice are errors."""
    found = kept(check_normalized(spark, path), "normalized")
    bad = F.col("problem").isNotNull()
    said = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.struct("line_number", "problem"))).alias("first")).first()
    if said.first:
        raise ValueError(f"manifest line {said.first.line_number}: {said.first.problem}")
    if not said.n:
        raise ValueError("the normalised manifest is empty")
    twice = found.groupBy("output_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.when(F.col("n") > 1, F.col("output_id"))).alias("id")).first().id
    if twice is not None:
        raise ValueError(f"the normalised manifest has output id {twice} twice")
    numbers = {"schema_version": "int", "width": "int", "height": "int", "num_frames": "int", "fps": "double"}
    return found.drop("problem").withColumns({n: F.col(n).cast("double").cast(k) for n, k in numbers.items()})
