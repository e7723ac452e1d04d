"""Keyed state with rules of its own, over streams that stop and go on.

Every operator is a stateful processor: the first row by position, collisions of plans, progress by time or rows, and sets that are
consumed within a step. State lives in the store of the query's checkpoint, so a query that was stopped goes on where it was.

Rows of one key that a micro-batch brings are put in order of their position in the task that has the key, which holds the fields it
needs of them; stages of bounded length (``stage_count``) and ``maxFilesPerTrigger`` bound their number.
State is one row per key (and, for consumed sets, one per index of the current step). A row whose key is null has the null key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a stage, about: one key may have them all, and its task holds them in order.
STAGE_ROWS = 2_000_000


def stage_count(rows: int, least: int = 1) -> int:
    """Stages that ``rows`` rows are taken in by."""
    return max(least, math.ceil(rows / STAGE_ROWS))


def _brought(rows: Iterator[Row], *fields: str) -> tuple[str | None, list[tuple]]:
    """A key's name and its rows' fields, in order of the first one."""
    name, out = None, []
    for row in rows:
        name = row["key"]
        out.append(tuple(row[f] for f in fields))
    out.sort(key=itemgetter(0))
    return name, out


class FirstByPosition(StatefulProcessor):
    """Emits a key's row whenever it has a smaller position than all before it."""

    def __init__(self, kind: T.StructType):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", T.StructType([self.kind["position"]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: r["position"])
        best = self.best.get()  # a call to the store is dearer than a row
        if best is None or first["position"] < best[0]:
            self.best.update((first["position"],))
            yield first

    def close(self) -> None:
        pass


class Collisions(StatefulProcessor):
    """A key's rows all name one plan; the first other plan fails the stream, or is reported once per key."""

    def __init__(self, fail: bool):
        self.fail = fail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("plan", T.StructType([T.StructField("plan", T.StringType()), T.StructField("collided", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        plan, collided = self.state.get() or (None, False)  # a call to the store is dearer than a row
        before = plan, collided
        name = None
        for row in rows:
            name = row["key"]
            if plan is None:
                plan = row["plan"]
            elif row["plan"] != plan and not collided:
                if self.fail:
                    raise ValueError(f"key collision with different plans: {name}")
                collided = True
                yield Row(key=name)
        if (plan, collided) != before:
            self.state.update((plan, collided))

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Emits a key's progress at a row that is ``rows`` behind the last emission, or ``seconds`` of event time after it."""

    KIND = T.StructType([T.StructField(n, T.LongType()) for n in ("processed", "emitted_rows", "emitted_us")])

    def __init__(self, rows: int, seconds: int):
        self.rows, self.span = rows, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", self.KIND)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        processed, emitted, at = self.state.get() or (0, 0, None)
        name, brought = _brought(rows, "position", "us")
        for position, us in brought:
            processed += 1
            if at is None:
                at = us  # the clock starts with the first row
            by_rows, by_time = processed - emitted >= self.rows, us - at >= self.span
            if by_rows or by_time:
                yield Row(key=name, position=position, processed=processed, rows_since=processed - emitted, by="rows" if by_rows else "time")
                emitted, at = processed, us
        self.state.update((processed, emitted, at))

    def close(self) -> None:
        pass


class ConsumedSets(StatefulProcessor):
    """Tells of each row whether its index is fresh in its step. Indices of a step are held until the next
    step of the key begins; then they are dropped. A row of an earlier step than the current one fails the stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step = handle.getValueState("step", T.StructType([T.StructField("step", T.LongType())]))
        self.taken = handle.getMapState("taken", T.StructType([T.StructField("index", T.LongType())]), T.StructType([T.StructField("position", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        step = (self.step.get() or (None,))[0]
        held = {k[0] for k in self.taken.keys()} if step is not None else set()
        old = set(held)
        before = step
        new: dict[int, int] = {}
        name, brought = _brought(rows, "position", "step", "index")
        for position, now, index in brought:
            if step is not None and now < step:
                raise ValueError(f"step {now} came after step {step}")
            if now != step:
                step, held, new = now, set(), {}
            fresh = index not in held
            if fresh:
                held.add(index)
                new[index] = position
            yield Row(key=name, step=now, position=position, index=index, fresh=fresh)
        if step != before:
            if old:
                self.taken.clear()
            self.step.update((step,))
        for index, position in new.items():
            self.taken.updateValue((index,), (position,))

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    return stream.groupBy("key").transformWithState(processor, out, "Append", "None")


def _struct(stream: DataFrame, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, stream.schema[n].dataType) for n in names])


def first_by_position(stream: DataFrame, key: Column, position: Column) -> DataFrame:
    """Rows (key, position, all columns as ``row``) that were first so far; the last emitted row of a key is its first by position."""
    named = stream.select(key.cast("string").alias("key"), position.alias("position"), F.struct("*").alias("row"))
    return _stateful(named, FirstByPosition(named.schema), named.schema)


def firsts(emitted: DataFrame) -> DataFrame:
    """The first row of each key among what ``first_by_position`` emitted."""
    return emitted.groupBy("key").agg(F.min_by("row", "position").alias("row")).select("row.*")


def collisions(stream: DataFrame, key: Column, plan: Column, fail: bool = True) -> DataFrame:
    """Keys that name two plans, each once; with ``fail`` the first one fails the stream."""
    named = stream.select(key.cast("string").alias("key"), F.coalesce(plan.cast("string"), F.lit("null")).alias("plan"))
    return _stateful(named, Collisions(fail), _struct(named, "key"))


def progress(stream: DataFrame, key: Column, position: Column, at: Column, rows: int, seconds: int) -> DataFrame:
    """(key, position, processed, rows_since, by): progress of each key every ``rows`` rows or ``seconds`` of event time."""
    named = stream.select(key.cast("string").alias("key"), position.cast("long").alias("position"), F.unix_micros(at.cast("timestamp")).alias("us"))
    out = T.StructType([*_struct(named, "key", "position"), T.StructField("processed", T.LongType()), T.StructField("rows_since", T.LongType()), T.StructField("by", T.StringType())])
    return _stateful(named, Progress(rows, seconds), out)


def consumed_sets(stream: DataFrame, key: Column, step: Column, position: Column, index: Column) -> DataFrame:
    """(key, step, position, index, fresh) of every row."""
    named = stream.select(key.cast("string").alias("key"), step.cast("long").alias("step"), position.cast("long").alias("position"), index.cast("long").alias("index"))
    return _stateful(named, ConsumedSets(), T.StructType([*_struct(named, "key", "step", "position", "index"), T.StructField("fresh", T.BooleanType())]))


class FileStream:
    """A query over a growing folder of parquet files. ``run`` takes in all files that are there and stops; the next run
    goes on from the checkpoint, so each file is read once. Results of a micro-batch go to a folder of its own, written anew
    if the batch is."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, plan: Callable[[DataFrame], DataFrame], base: str | None = None, files: int = 64):
        self.spark, self.folder, self.schema, self.plan, self.files = spark, folder, schema, plan, files
        self.base = base or f"{shared_dir(spark)}/sluice/stream-{uuid.uuid4().hex}"
        self.out: T.StructType | None = None

    def run(self) -> list[dict]:
        """Progress reports of the micro-batches of this run."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.folder)
        result = self.plan(source)
        self.out = result.schema

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.base}/out/batch={number}")

        old = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            query = result.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.unset(PROVIDER) if old is None else self.spark.conf.set(PROVIDER, old)
        return [p for p in query.recentProgress if p["numInputRows"]]

    def result(self) -> DataFrame:
        """All that was emitted, with the number of its ``batch``."""
        if self.out is None:
            self.out = self.plan(self.spark.readStream.schema(self.schema).parquet(self.folder)).schema
        return self.spark.read.schema(T.StructType([*self.out.fields, T.StructField("batch", T.LongType())])).option("recursiveFileLookup", "false").parquet(f"{self.base}/out")


def run_in_stages(spark: SparkSession, stages: list[DataFrame], plan: Callable[[DataFrame], DataFrame], files: int = 64) -> DataFrame:
    """``plan`` over rows that come in stages: each is put into one folder, taken in by a run that then stops."""
    base = f"{shared_dir(spark)}/sluice/stream-{uuid.uuid4().hex}"
    stream = FileStream(spark, f"{base}/in", stages[0].schema, plan, base, files)
    for stage in stages:
        stage.write.mode("append").parquet(f"{base}/in")
        stream.run()
    return stream.result()
