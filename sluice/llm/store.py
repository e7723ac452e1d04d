"""Tables kept in the cluster's shared folder, and session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none a local master gets a temporary folder; on a cluster
    executors would each write to their own disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and no
    later stage depends on an executor staying alive."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sluice/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names like ``names`` that no column of ``df`` has (Spark folds case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_name(id_col, text_col):
    """A string that names a row: its id and its text's hash. Null ids are told apart by text."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.concat_ws(":", number, F.xxhash64(F.col(text_col).cast("string")).cast("string"))


def slots(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession) -> None:
    """Delete all tables that ``keep`` and the bucketed text copies left behind. Call it when
    no result of this session is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/sluice")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for found in spark.catalog.listTables(pattern="sluice_texts_*"):
        spark.sql(f"DROP TABLE IF EXISTS {found.name}")
