"""Row ranges and point reads that open only what they need.

Parquet: rows are numbered by file (in order of path) and place in the file. Counts per file come from a scan without columns,
which reads footers only; a range then reads the files that overlap it, with a filter on the place in the first and last one.

JSON lines: an index is stored as two tables beside each other. ``entries`` has a row per line that is not blank (row, file, offset, length, and fields of
the record), sorted by row, so a lookup of rows prunes by statistics; ``sources`` has a row per file (size, time of change, SHA-256,
lines). The scan that builds it reads files in byte ranges: a line belongs to the range in which it starts. A read takes
entries to their lines by seeking; runs of entries that lie together are read at once. An index whose files have changed is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.operators.identity import with_row_index

#: Bytes of one range of the index scan, and of one read.
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
VERSION = 3


def _opened(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int, int]]:
    """(file, size, time of change in ns) below a path in order of name, without hidden files."""
    from pyarrow import fs

    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    files = [(f.path, f.size, f.mtime_ns) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = "" if urlparse(path).scheme in ("", "file") else path[: path.index("://") + 3]
    return sorted((prefix + name, size, changed) for name, size, changed in files)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class LineRanges(DataSource):
    """Lines of files by byte ranges: file, offset, length (without the line's end), line. Blank lines give no row; of
    ``\\r\\n`` the ``\\r`` belongs to the end."""

    @classmethod
    def name(cls) -> str:
        return "sluice_lines"

    def schema(self) -> str:
        return "file string, offset long, length int, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class _LineReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[_Range]:
        return [_Range(f, at, min(at + self.size, n)) for f, n, _ in _listed(self.path) for at in range(0, n, self.size)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, place = _opened(part.file)
        rows: list[tuple[int, int, bytes]] = []
        held = 0
        with system.open_input_file(place) as handle:
            for offset, line in _lines(handle, part.start, part.end):
                body = line.rstrip(b"\r")
                if body.strip():
                    rows.append((offset, len(body), body))
                    held += len(body)
                if held >= READ_BYTES:
                    yield _batch(part.file, rows)
                    rows, held = [], 0
        if rows:
            yield _batch(part.file, rows)


def _batch(file: str, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    offset, length, line = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int32()), pa.array([x.decode("utf-8") for x in line])], names=["file", "offset", "length", "line"])


def _lines(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its ``\\n``) of all lines that start in [start, end)."""
    size, at = handle.size(), start
    if start:
        handle.seek(start - 1)  # a line starts here only if the byte before ends one
        at = start - 1
    left = b""
    skip = start > 0
    while at < size:
        block = handle.read(READ_BYTES)
        if not block:
            break
        parts = (left + block).split(b"\n")
        place = at - len(left)
        at += len(block)
        for line in parts[:-1]:
            if skip:
                skip = False
            elif place >= end:
                return
            else:
                yield place, line
            place += len(line) + 1
        left = parts[-1]
        if not skip and place >= end:
            return
    if left and not skip and at - len(left) < end:
        yield at - len(left), left


def scan_line_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All lines of the files below a path with their places."""
    spark.dataSource.register(LineRanges)
    return spark.read.format("sluice_lines").option("path", path).option("rangeBytes", range_bytes).load()


def _checked(line: Column) -> Column:
    """The line; reading fails where it is no JSON object."""
    good = F.get_json_object(line, "$").isNotNull() & F.ltrim(line).startswith("{")
    return F.when(F.assert_true(good, F.concat(F.lit("not a JSON object: "), F.substring(line, 1, 80))).isNull(), line)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file in batch.column("file").to_pylist():
            system, place = _opened(file)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as handle:
                while block := handle.read(READ_BYTES):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield batch.append_column("sha256", pa.array(out, pa.string()))


def hashed_paths(files: DataFrame) -> DataFrame:
    """Rows of files (file, size, changed) with their SHA-256, read in pieces, a task per some files."""
    return files.repartition(max(1, min(files.count(), 4096)), "file").mapInArrow(_hashes, "file string, size long, changed long, sha256 string")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed) of the data files below a path."""
    return _sources(spark, path)


def _sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(_listed(path), "file string, size long, changed long")  # a row per file


def build_index(spark: SparkSession, path: str, to: str, fields: dict[str, str], range_bytes: int = RANGE_BYTES) -> None:
    """Store the index of the JSON lines below ``path`` in ``to``. fields: column name -> JSON path in the record."""
    files = _sources(spark, path)
    lines = scan_line_ranges(spark, path, range_bytes)
    line = _checked(F.col("line"))
    entries = lines.select("file", "offset", "length", *[F.get_json_object(line, where).alias(name) for name, where in fields.items()])
    numbered = with_row_index(entries, ["file", "offset"], "row")
    numbered.repartitionByRange("row").sortWithinPartitions("row").write.parquet(f"{to}/entries")
    hashed = hashed_paths(files)
    counts = spark.read.parquet(f"{to}/entries").groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.min("row").alias("first_row"))
    hashed.join(counts, "file", "left").select(F.lit(VERSION).alias("version"), "*").fillna(0, ["lines"]).write.parquet(f"{to}/sources")


def changed_files(spark: SparkSession, index: str, path: str, content: bool = False) -> DataFrame:
    """Files (and why) that are not as they were when the index was stored; with ``content`` their hashes count, not their times."""
    now = _sources(spark, path)
    if content:
        now = hashed_paths(now)
    what = ["size", "sha256" if content else "changed"]
    old = spark.read.parquet(f"{index}/sources")
    both = old.select("file", *[F.col(c).alias(f"old_{c}") for c in what]).join(now.select("file", *what), "file", "full")
    problem = F.when(F.col(f"old_{what[0]}").isNull(), "new").when(F.col(what[0]).isNull(), "gone")
    for c in what:
        problem = problem.when(F.col(c) != F.col(f"old_{c}"), c)
    return both.select("file", problem.alias("problem")).where("problem is not null")


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The line of every entry, read from its place; entries of a batch that follow one another are read at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, offset, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        order = sorted(range(batch.num_rows), key=lambda i: (file[i], offset[i]))
        out: list[str | None] = [None] * batch.num_rows
        handle, name, at = None, None, 0
        while at < len(order):
            first = order[at]
            if file[first] != name:
                if handle is not None:
                    handle.close()
                name = file[first]
                system, place = _opened(name)
                handle = system.open_input_file(place)
            last, end = at, offset[first] + length[first]
            while last + 1 < len(order) and file[order[last + 1]] == name and offset[order[last + 1]] <= end + 2 and offset[order[last + 1]] + length[order[last + 1]] - offset[first] <= READ_BYTES:
                last += 1
                end = offset[order[last]] + length[order[last]]
            block = handle.read_at(end - offset[first], offset[first])
            for i in order[at : last + 1]:
                start = offset[i] - offset[first]
                out[i] = block[start : start + length[i]].decode("utf-8")
            at = last + 1
        if handle is not None:
            handle.close()
        yield batch.append_column("line", pa.array(out, pa.string()))


def read_entries(entries: DataFrame) -> DataFrame:
    """Entries of an index with their lines, each read from its file and byte range."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(_fetched, f"{kinds}, line string")


def open_index(spark: SparkSession, index: str, path: str) -> DataFrame:
    """The entries of an index; an index whose files have changed since is refused."""
    stale = changed_files(spark, index, path).limit(5).collect()
    if stale:
        raise ValueError("stale index: " + ", ".join(f"{r.file} ({r.problem})" for r in stale))
    return spark.read.parquet(f"{index}/entries")


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n) of the parquet files below a path: the position of each file's first row, and its rows."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"), "n")  # a row per file


def read_row_range(spark: SparkSession, path: str, low: int, high: int, columns: list[str] | None = None) -> DataFrame:
    """Rows at positions [low, high) of the parquet files below a path, with ``position``. Only files that overlap the range are
    opened, and no row is moved."""
    whole = spark.read.parquet(path)
    wanted = [f"`{c}`" for c in columns or whole.columns]
    some = numbered_files(spark, path).where((F.col("start") < high) & (F.col("start") + F.col("n") > low)).orderBy("start").collect()  # files of the range
    if not some:
        return whole.limit(0).select(*wanted, F.lit(0).cast("long").alias("position"))
    part = spark.read.schema(whole.schema).parquet(*[unquote(r.file) for r in some])
    at = F.col("_metadata.row_index")
    file = F.col("_metadata.file_path")
    if len(some) == 1:
        start = F.lit(some[0].start)
        return part.where((at >= low - some[0].start) & (at < high - some[0].start)).select(*wanted, (start + at).alias("position"))
    inside = F.when(file == some[0].file, at >= low - some[0].start).when(file == some[-1].file, at < high - some[-1].start).otherwise(True)
    starts = F.broadcast(spark.createDataFrame([(r.file, r.start) for r in some], "_file string, _start long"))  # files of the range
    rows = part.where(inside).select(*wanted, file.alias("_file"), at.alias("_at"))
    return rows.join(starts, "_file").select(*wanted, (F.col("_start") + F.col("_at")).alias("position"))
