"""Session settings the engine relies on."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sluice", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with ANSI and adaptive execution on. On a cluster leave ``master``
    and ``partitions`` to spark-submit; AQE then coalesces shuffles and splits skewed joins."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may go without, and
    then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sluice-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def dealt(df: DataFrame, of: DataFrame | None = None, rows: int = 1 << 13) -> DataFrame:
    """``df`` dealt over a task per ``rows`` rows (of ``of``, if counting that is cheaper), 4,096 at most. For work that is heavy per
    row: small files, and shuffles that adaptive execution puts together by bytes, make too few tasks for it."""
    return df.repartition(min(max(1, math.ceil((df if of is None else of).count() / rows)), 4096))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/sluice/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
