"""Sinks: accepted and rejected rows, shard markers, captions, and path policy."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import kept
from sluice.sources.offsets import hashed_paths, listed_files


class PathPolicy:
    """Roots that may be written or read; denied roots win. Paths are compared by parts."""

    def __init__(self, allowed: list[str], denied: list[str] | None = None):
        self.allowed = [self._parts(p) for p in allowed]
        self.denied = [self._parts(p) for p in denied or []]

    @staticmethod
    def _parts(path: str) -> list[str]:
        scheme, sep, rest = path.partition("://")
        return [scheme + sep] * bool(sep) + posixpath.normpath(rest if sep else path).split("/")

    def check(self, path: str) -> str:
        parts = self._parts(path)
        under = lambda root: parts[: len(root)] == root
        if any(map(under, self.denied)) or not any(map(under, self.allowed)):
            raise PermissionError(f"path is not allowed: {path}")
        return path


def without_internal(df: DataFrame, prefix: str = "_build_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def publish(df: DataFrame, path: str, order: list[str], reason: str = "reason", policy: PathPolicy | None = None) -> dict[str, str]:
    """Accepted and rejected rows, each ordered within its files, in a new folder under ``path``; a summary by
    reason is written last, so its presence marks a complete publish and generations never mix."""
    if policy:
        policy.check(path)
    base = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    df = kept(df, "publish")
    accepted, rejected = df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
    without_internal(accepted.sortWithinPartitions(*order)).write.mode("overwrite").parquet(f"{base}/accepted")
    rejected.sortWithinPartitions(*order).write.mode("overwrite").json(f"{base}/rejected")
    summary = df.groupBy(F.coalesce(reason, F.lit("accepted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    summary.coalesce(1).write.mode("overwrite").json(f"{base}/summary")
    return {k: f"{base}/{k}" for k in ("accepted", "rejected", "summary")}


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, sha256 of every data file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.rlike("^[._]")).select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


MARKER = "task string, shard int, fingerprint string, n_rows long, accepted long, rejected long, reasons map<string,long>, files array<struct<name:string,size:long,sha256:string>>, at long"


def _shard_files(spark: SparkSession, base: str) -> DataFrame:
    """task, shard, files (name, size, sha256) of what lies in each shard's folder."""
    if not _exists(spark, f"{base}/data"):
        return spark.createDataFrame([], "task string, shard int, files array<struct<name:string,size:long,sha256:string>>")
    found = hashed_paths(listed_files(spark, f"{base}/data"))
    part = lambda key: F.url_decode(F.regexp_extract("file", f"/{key}=([^/]*)/", 1))
    name = F.element_at(F.split("file", "/"), -1)
    return found.groupBy(part("task").alias("task"), part("shard").cast("int").alias("shard")).agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), "size", "sha256"))).alias("files"))


def markers(spark: SparkSession, path: str) -> DataFrame:
    """The last marker of each task, shard and fingerprint; none if there is no marker table yet."""
    marker = f"{path.rstrip('/')}/_markers"
    rows = spark.read.schema(MARKER).json(marker) if _exists(spark, marker) else spark.createDataFrame([], MARKER)
    last = F.max_by(F.struct(*rows.columns), "at")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in ("task", "shard", "fingerprint")]).agg(last.alias("m")).select("m.*").drop("at")


def done_shards(spark: SparkSession, path: str) -> DataFrame:
    """Markers of shards whose files are all there, with the hashes they had when the marker was written, and no others."""
    base = path.rstrip("/")
    now = _shard_files(spark, base).withColumnRenamed("files", "_files")
    return markers(spark, base).join(now, ["task", "shard"], "left").where(F.col("files").eqNullSafe(F.col("_files"))).drop("_files")


def publish_shards(df: DataFrame, path: str, fingerprint: str) -> int:
    """Write rows (task, shard, ...) of shards that are not done under this fingerprint, then their markers with row counts
    (accepted ones are those without a ``reason``, if there is such a column) and file hashes. A shard whose marker and files differ is
    written anew; done shards are left as they are. Rows are dealt by Spark's rebalancing, so a large shard is several files.
    Returns the number of shards written."""
    spark = df.sparkSession
    base = path.rstrip("/")
    done = kept(done_shards(spark, base).where(F.col("fingerprint") == fingerprint).select("task", "shard"), "done")
    todo = kept(df.join(F.broadcast(done), ["task", "shard"], "left_anti"), "todo")  # a row per shard
    reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    each = todo.groupBy("task", "shard", reason.alias("_reason")).agg(F.count(F.lit(1)).alias("_n"))
    rejected = F.coalesce(F.sum(F.when(F.col("_reason").isNotNull(), F.col("_n"))), F.lit(0))
    named = F.map_from_entries(F.collect_list(F.when(F.col("_reason").isNotNull(), F.struct("_reason", "_n"))))
    counts = kept(each.groupBy("task", "shard").agg(F.sum("_n").alias("n_rows"), (F.sum("_n") - rejected).alias("accepted"), rejected.alias("rejected"), named.alias("reasons")), "counts")
    written = counts.count()
    if written:
        todo.hint("rebalance", "task", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "shard").parquet(f"{base}/data")
        marked = counts.join(_shard_files(spark, base), ["task", "shard"]).withColumn("fingerprint", F.lit(fingerprint)).withColumn("at", F.unix_micros(F.current_timestamp()))
        marked.select(*[f.name for f in T._parse_datatype_string(MARKER)]).coalesce(1).write.mode("append").json(f"{base}/_markers")
    return written


def shard_counters(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Counters of all done shards of a build, a row each, from their markers alone."""
    return done_shards(spark, path).where(F.col("fingerprint") == fingerprint).select("task", "shard", "n_rows", "accepted", "rejected", "reasons")


def save_captions(df: DataFrame, path: str, kind: str) -> None:
    """(path, caption) rows as csv, json, jsonl or a pair of text files."""
    rows = df.select("path", "caption")
    if kind in ("json", "jsonl"):
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "txt":
        ordered = rows.orderBy("path")
        ordered.select("caption").write.mode("overwrite").text(f"{path.rstrip('/')}/captions")
        ordered.select("path").write.mode("overwrite").text(f"{path.rstrip('/')}/paths")
    else:
        raise ValueError(f"unknown caption format: {kind}")


def records_to_jsonl(df: DataFrame, path: str, key: str = "_record_key") -> None:
    """Records keyed by id as JSON lines; rows that name their own id keep it."""
    own = F.col("source_record_id") if "source_record_id" in df.columns else F.lit(None).cast("string")
    df.withColumn("source_record_id", F.coalesce(own, F.col(key))).drop(key, "_pos").write.mode("overwrite").json(path)
