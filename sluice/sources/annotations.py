"""Readers for annotation files of several formats, and the row ids they give."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import resolve_path
from sluice.operators.identity import with_row_index
from sluice.session import shared_dir

SUFFIXES = ("parquet", "jsonl", "json", "csv")
ID_FIELDS = ("source_record_id", "key", "id")


def suffix_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of a parquet, jsonl, json (list, or object of records) or csv file.

    A broken JSON line fails the read; csv values stay strings; a json object of
    records gives its keys as ``_record_key``."""
    kind = suffix_of(path)
    reader = spark.read.schema(schema) if schema is not None and kind != "parquet" else spark.read
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    if kind == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        if whole.where(F.ltrim("value").startswith("{")).limit(1).count():
            return scan_records(spark, path, schema)
        return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    raise ValueError(f"unsupported annotation file: {path}")


def scan_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An object of records: one row per key, in the file's order of keys. Without a schema it is inferred from
    the records, written as lines to the shared folder."""
    whole = spark.read.text(path, wholetext=True)  # one JSON document is one record
    pairs = whole.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("_pos", "_record_key", "_raw"))
    if schema is None:
        lines = f"{shared_dir(spark)}/sluice/records-{uuid.uuid4().hex}"
        pairs.select("_raw").write.text(lines)
        schema = spark.read.json(lines).schema
    return pairs.select("_pos", "_record_key", F.from_json("_raw", schema).alias("r")).select("_pos", "_record_key", "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_number (1-based, physical) and raw of a text file, read in splits: lines are
    ordered by file, by their block's place in it, then by their place in the block."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return with_row_index(lines, ["_file", "_block", "_at"], "_line").select((F.col("_line") + 1).alias("line_number"), "raw")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL as text with physical line numbers; blank lines are left out but counted."""
    return numbered_lines(spark, path).where(F.trim("raw") != "")


def row_id(fallback: Column, columns: list[str]) -> Column:
    """The first non-blank of source_record_id, key, id among ``columns``; else ``fallback``."""
    found = [F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in ID_FIELDS if c in columns]
    return F.coalesce(*found, fallback.cast("string"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources under one schema, each row with its source's number as dataset_order."""
    numbered = [df.withColumn("dataset_order", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def media_column(df: DataFrame, column: str, root: str) -> DataFrame:
    """Paths of a metadata column, trimmed and resolved against the folder of their file."""
    return df.where(F.trim(F.col(column)) != "").select(resolve_path(root, F.trim(F.col(column))).alias("path"))


def shared_files(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """Folders under every root at the same relative place, with files that fit ``pattern``: rel (with a slash
    behind it), n_roots, size of all."""
    found = None
    for root in roots:
        name = root.rstrip("/").rsplit("/", 1)[-1]
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        one = one.select(F.regexp_replace(F.substring_index("path", f"/{name}/", -1), "[^/]*$", "").alias("rel"), F.lit(name).alias("root"), "length")
        found = one if found is None else found.unionAll(one)
    return found.groupBy("rel", "root").agg(F.sum("length").alias("length")).groupBy("rel").agg(F.count(F.lit(1)).alias("n_roots"), F.sum("length").alias("size")).where(F.col("n_roots") == len(roots))


def shared_folders(files: DataFrame) -> DataFrame:
    """The folders of files (rel, n_roots), once each: a table written by Spark is a folder of parts."""
    folder = F.regexp_replace("rel", "/[^/]*$", "")
    return files.groupBy(folder.alias("rel"), "n_roots").count().drop("count")


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """Paths and sizes of media files by extension, any case, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    return found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*[e.lower().lstrip(".") for e in extensions])).orderBy("path")


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a file: parquet from its footers, jsonl by lines (blank ones count), json by
    parsing; unknown for csv."""
    kind = suffix_of(path)
    if kind == "csv":
        return None
    if kind == "jsonl":
        return spark.read.text(path).count()
    return scan(spark, path).count()


def caption_pairs(spark: SparkSession, captions: str, paths: str) -> DataFrame:
    """Two text files joined line by line."""

    one = numbered_lines(spark, captions).select("line_number", F.col("raw").alias("caption"))
    two = numbered_lines(spark, paths).select("line_number", F.col("raw").alias("path"))
    return one.join(two, "line_number").orderBy("line_number").drop("line_number")
