"""Several tables published as one generation.

Tables are staged in a folder of their own, their files are hashed, and a marker with all hashes is written last. A pointer file
then names the generation; it is replaced by one rename, so a reader sees the old tables or the new ones, never some of both, and a run
that ends before the rename changes nothing. Readers hold the generation that the pointer named when they were opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.offsets import hashed_paths, listed_files

POINTER, MARKER = "CURRENT", "marker.json"


class _Files:
    """Small files of a root, through the cluster's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        path = self.path(name)
        return path.getFileSystem(self.conf).exists(path)

    def get(self, name: str) -> str:
        path = self.path(name)
        stream = path.getFileSystem(self.conf).open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        path = self.path(name)
        stream = path.getFileSystem(self.conf).create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside and rename it over the old one."""
        beside = f"_{name}.{uuid.uuid4().hex}"
        self.put(beside, text)
        source, target = self.path(beside), self.path(name)
        how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, how)


class Generation:
    """``with Generation(spark, root) as g: g.stage(name, df)``: all is published when the block ends without an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, _Files(spark, root)
        self.id = uuid.uuid4().hex
        self.base = f"{self.files.root}/generations/{self.id}"
        self.tables: dict[str, str] = {}

    def __enter__(self) -> Generation:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()

    def stage(self, name: str, df: DataFrame, kind: str = "parquet", by: list[str] | None = None) -> None:
        """Write a table of the generation; ``by`` parts it into a folder per value (a bundle per sample), which tasks write."""
        if name in self.tables:
            raise ValueError(f"staged twice: {name}")
        out = df.write.partitionBy(*by) if by else df.write
        out.format(kind).save(f"{self.base}/tables/{name}")
        self.tables[name] = kind

    def commit(self) -> None:
        """Hash all files, write the marker, then switch the pointer."""
        base = f"{self.base}/tables"
        hashed = hashed_paths(listed_files(self.spark, base)).orderBy("file").collect() if self.tables else []  # a row per file
        files = [{"name": r.file.split(f"/{self.id}/tables/", 1)[1], "size": r.size, "sha256": r.sha256} for r in hashed]
        before = Current(self.spark, self.files.root).history() if self.files.exists(POINTER) else []
        self.files.put(f"generations/{self.id}/{MARKER}", json.dumps({"tables": self.tables, "files": files}, sort_keys=True))
        self.files.replace(POINTER, json.dumps([*before, self.id]))


class Current:
    """The generation that a root's pointer names now."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.small = spark, _Files(spark, root)
        if not self.small.exists(POINTER):
            raise FileNotFoundError(f"nothing is published in {root}")
        self._history = json.loads(self.small.get(POINTER))
        self.id = self._history[-1]
        self.base = f"{self.small.root}/generations/{self.id}"
        self.marker = json.loads(self.small.get(f"generations/{self.id}/{MARKER}"))

    def history(self) -> list[str]:
        return list(self._history)

    def files(self) -> list[dict]:
        return self.marker["files"]

    def changed(self, content: bool = False) -> DataFrame:
        """Files that are not as the marker says: by size, or (with ``content``) by hash."""
        now = listed_files(self.spark, f"{self.base}/tables")
        now = hashed_paths(now) if content else now
        what = ["size", "sha256"] if content else ["size"]
        found = now.toArrow().to_pylist()  # a row per file
        got = {r["file"].split(f"/{self.id}/tables/", 1)[1]: tuple(r[c] for c in what) for r in found}
        want = {f["name"]: tuple(f[c] for c in what) for f in self.files()}
        bad = sorted(n for n in got.keys() | want.keys() if got.get(n) != want.get(n))
        return self.spark.createDataFrame([(n,) for n in bad], "name string")

    def read(self, name: str, content: bool = False) -> DataFrame:
        """A table of this generation; refused if its files are not those of the marker."""
        bad = [r.name for r in self.changed(content).collect() if r.name.startswith(f"{name}/")]
        if bad:
            raise ValueError(f"files differ from their marker: {', '.join(bad[:5])}")
        return self.spark.read.format(self.marker["tables"][name]).load(f"{self.base}/tables/{name}")
