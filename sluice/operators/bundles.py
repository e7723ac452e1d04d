"""Selection bundles: a folder per selected sample with its prompt and copies of its references, and the list of all samples.

A bundle is published as a generation (``operators/generations.py``), so a run that ends early leaves the old one, and its files are
hashed. Tasks write the folders and copy the references; only the marker is written by the driver. Tables of a bundle:

* ``selected_samples``: JSON lines in order of selection; paths lie below the bundle
* ``samples``: ``sample_dir=<name>/`` with the prompt as text
* ``references``: ``sample_dir=<name>/reference_00.png`` and so on
* ``summary``: samples and references by task
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import is_absolute, normal_path, sample_dir
from sluice.operators.generations import Current, Generation
from sluice.session import kept
from sluice.sources.annotations import numbered_lines
from sluice.sources.offsets import READ_BYTES, _opened

#: The tasks a sample may have.
TASKS = ("i2i", "r2v")


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copy ``source`` to ``target``, in pieces, beside its name first; a task that runs again writes the same bytes."""
    for batch in batches:
        sizes = []
        for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
            (here, at), (there, to) = _opened(source), _opened(target)
            there.create_dir(posixpath.dirname(to), recursive=True)
            beside = f"{posixpath.dirname(to)}/.{uuid.uuid4().hex}"
            size = 0
            with here.open_input_stream(at) as read, there.open_output_stream(beside) as write:
                while block := read.read(READ_BYTES):
                    write.write(block)
                    size += len(block)
            there.move(beside, to)
            sizes.append(size)
        yield batch.append_column("size", pa.array(sizes, pa.int64()))


def write_bundle(samples: DataFrame, root: str, order: list[str], overwrite: bool = False) -> str:
    """Publish selected samples (task, sample_key, caption, reference_paths, and any other columns) in ``order``; returns the generation.

    A bundle that is there already is only replaced with ``overwrite``. References of any file system that pyarrow opens are
    copied by tasks; one that cannot be read fails the run, and the old bundle stays. Two samples with one task and key would share
    a folder, which is an error. A sample without references has none exported; a reference without a suffix is named .png."""
    spark = samples.sparkSession
    generation = Generation(spark, root)
    if not overwrite and generation.files.exists("CURRENT"):
        raise FileExistsError(f"a bundle is published already: {root}")
    suffix = lambda x: F.lower(F.regexp_extract(F.substring_index(x, "/", -1), r"[^.](\.[^.]+)$", 1))
    paths = F.coalesce("reference_paths", F.array().cast("array<string>"))
    # more than a hundred references of one sample keep their number whole
    number = lambda i: F.when(i < 100, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string"))
    name = lambda x, i: F.concat(F.lit("reference_"), number(i), F.coalesce(F.nullif(suffix(x), F.lit("")), F.lit(".png")))
    chosen = samples.withColumn("sample_dir", sample_dir(F.col("task"), F.col("sample_key")))
    rows = kept(chosen.withColumn("_names", F.transform(paths, name)), "bundle")
    twice = rows.groupBy("sample_dir").count().agg(F.min(F.when(F.col("count") > 1, F.col("sample_dir"))).alias("d")).first().d
    if twice is not None:
        raise ValueError(f"two samples share the folder {twice}")
    with generation as g:
        base = f"{g.base}/tables/references"
        each = rows.select("sample_dir", F.posexplode(F.arrays_zip(paths.alias("source"), F.col("_names").alias("name"))).alias("_i", "r"))
        copies = each.select(F.col("r.source").alias("source"), F.concat(F.lit(f"{base}/sample_dir="), "sample_dir", F.lit("/"), "r.name").alias("target"), "sample_dir")
        sizes = kept(copies.repartition("sample_dir").mapInArrow(_copied, "source string, target string, sample_dir string, size long"), "copies")
        if not sizes.isEmpty():
            g.tables["references"] = "binaryFile"
        g.stage("samples", rows.select("sample_dir", F.coalesce("caption", F.lit("")).alias("value")), "text", ["sample_dir"])
        exports = F.transform("_names", lambda n: F.concat(F.lit("references/sample_dir="), F.col("sample_dir"), F.lit("/"), n))
        out = rows.withColumns({"original_reference_paths": F.col("original_reference_paths") if "original_reference_paths" in rows.columns else paths, "reference_exports": exports, "reference_paths": exports}).drop("_names")
        line = F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"})
        g.stage("selected_samples", out.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")), "text")
        bytes_ = sizes.groupBy("sample_dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        summary = rows.select("task", "sample_dir").join(bytes_, "sample_dir", "left").groupBy("task").agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        g.stage("summary", summary, "json")
    return g.id


def read_selected(spark: SparkSession, path: str, schema=None, tasks: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a list of JSON lines: those of ``tasks``, the first ``limit`` of them. ``line_number`` gives their order; rows only come
    sorted under a limit.

    References are the exported ones if there are any, else ``reference_paths``; relative ones lie below the list's folder. What the
    list itself says stays in ``original_reference_paths``. Blank lines are left out; a line of another task than the known ones is an
    error, wherever it stands. The schema is inferred if it is not given; an empty list gives no rows."""
    lines = numbered_lines(spark, path).where(F.trim("raw") != "")
    if schema is None:
        schema = spark.read.json(path).schema
    rows = lines.select("line_number", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("r")).select("line_number", "r.*")
    if "task" not in rows.columns:
        if not rows.isEmpty():
            raise ValueError(f"samples without a task: {path}")
        return rows
    known = F.coalesce(F.col("task").isin(*TASKS), F.lit(False))
    said = F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(" has no known task: "), F.coalesce("task", F.lit("none")))
    rows = rows.withColumn("task", F.when(known, F.col("task")).otherwise(F.raise_error(said)))
    none = F.lit(None).cast("array<string>")
    own = F.col("reference_paths") if "reference_paths" in rows.columns else none
    exported = F.col("reference_exports") if "reference_exports" in rows.columns else none
    values = F.coalesce(exported, own, F.array().cast("array<string>"))
    folder = posixpath.dirname(path.rstrip("/"))
    scheme, sep, place = folder.partition("://") if "://" in folder else ("", "", folder)
    below = lambda x: F.concat(F.lit(scheme + sep), normal_path(F.concat(F.lit(place.rstrip("/") + "/"), x)))
    rebased = F.transform(values, lambda x: F.when(is_absolute(x) | x.contains("://"), x).otherwise(below(x)))
    rows = rows.withColumn("original_reference_paths", F.coalesce(own, values)).withColumn("reference_paths", rebased)
    if tasks is not None:
        rows = rows.where(F.col("task").isin(*tasks))
    return rows if limit is None else rows.orderBy("line_number").limit(limit)


def read_bundle(spark: SparkSession, root: str, schema=None, tasks: tuple[str, ...] | None = None, limit: int | None = None, content: bool = False) -> DataFrame:
    """``read_selected`` of a published bundle, whose files must be those of its marker (by size, or by hash with ``content``)."""
    now = Current(spark, root)
    now.read("selected_samples", content)
    return read_selected(spark, f"{now.base}/tables/selected_samples", schema, tasks, limit)
