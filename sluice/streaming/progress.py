"""Stream operators: keyed first-wins, progress windows, running a bounded stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir


def first_wins(stream: DataFrame, key: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row seen of each key. Without a watermark state grows with the keys; with
    one, (column, delay), it is dropped after the delay."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def hourly_progress(stream: DataFrame) -> DataFrame:
    """Counts and mean values per hour of event time."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    counted = rows.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("h"), "n", "mean_value")


def run_once(spark: SparkSession, directory: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run ``plan`` over all of a parquet table as a stream, to its end, and return the result.

    Offsets and state go to the shared checkpoint folder; append results to parquet beside
    them, complete results (a row per group) to a batch table through foreachBatch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 64).parquet(directory)
    out = f"{base}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    result = plan(source)
    result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
