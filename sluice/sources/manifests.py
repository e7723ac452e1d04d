"""Manifests of JSON lines without an index: every line is looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.operators.identity import with_row_index
from sluice.operators.reject import first_reason
from sluice.operators.validate import row_reason
from sluice.sources.offsets import RANGE_BYTES, scan_line_ranges


def scan_manifest(spark: SparkSession, path: str, schema: StructType, compact: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per line that is not blank, numbered over all files (row, file, offset, length, task, dataset), with its ``problem``.

    The full scan validates the record of ``schema`` (``validate.row_reason``); the compact one only looks at the task. Files are read
    in byte ranges."""
    line = F.col("line")
    object_ = F.ltrim(line).startswith("{") & F.get_json_object(line, "$").isNotNull()
    task = F.get_json_object(line, "$.task")
    entries = scan_line_ranges(spark, path, range_bytes)
    names = ["file", "offset", "length", task.alias("task"), F.get_json_object(line, "$.dataset_name").alias("dataset")]
    unknown = ("unknown_task", ~F.coalesce(task.isin("i2i", "r2v"), F.lit(False)))
    problem = first_reason([("not_an_object", ~F.coalesce(object_, F.lit(False))), unknown])
    if compact:
        found = entries.select(*names, problem.alias("problem"))
    else:
        read = entries.select(*names, problem.alias("_problem"), F.from_json(line, schema).alias("r"))
        places = [F.col(c).alias(f"_{c}") for c in ("file", "offset", "length", "task", "dataset")]
        flat = read.select(*places, "_problem", "r.*")
        reason = F.coalesce("_problem", row_reason(flat, [f.name for f in schema if f.name != "sample_plan_sha256"]))
        found = flat.select(*[F.col(f"_{c}").alias(c) for c in ("file", "offset", "length", "task", "dataset")], reason.alias("problem"))
    return with_row_index(found, ["file", "offset"], "row")


def scanned_entries(spark: SparkSession, path: str, schema: StructType, compact: bool = False) -> DataFrame:
    """Entries as a stored index has them, for ``offsets.read_entries``; the first row with a problem is an error."""
    found = scan_manifest(spark, path, schema, compact)
    first = found.where("problem is not null").agg(F.min(F.struct("row", "problem")).alias("m")).first().m
    if first is not None:
        raise ValueError(f"manifest row {first.row}: {first.problem}")
    return found.drop("problem")
