"""Row ranges of parquet files, and the stored offset index of JSON lines."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluice.sources import offsets


@pytest.fixture
def lines(tmp_path):
    folder = tmp_path / "manifest set"
    folder.mkdir()
    one = [json.dumps({"id": i, "task": "i2i" if i % 3 else "r2v", "text": "é" * (i % 7) + " x" * i}, ensure_ascii=i % 2 == 0) for i in range(40)]
    two = [json.dumps({"id": 100 + i, "task": "r2v"}) for i in range(25)]
    (folder / "a.jsonl").write_bytes(("\n\n".join(one[:20]) + "\n  \n" + "\r\n".join(one[20:])).encode())  # blank lines, both ends, no last end
    (folder / "b.jsonl").write_bytes(("\r\n" + "\n".join(two) + "\n").encode())
    (folder / "c.jsonl").write_bytes(b"")
    (folder / "_hidden").write_bytes(b"{}\n")
    return str(folder), [json.loads(x) for x in one + two]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_is_in_one_range(spark, lines, size):
    path, records = lines
    if size == 1:  # a range per byte, without Spark
        found = []
        for name, n, _ in offsets._listed(path):
            with open(name, "rb") as f:
                raw = f.read()
            import pyarrow as pa

            for at in range(n):
                found += [(name, o, line) for o, line in offsets._lines(pa.OSFile(name), at, at + 1)]
            assert all(raw[o : o + len(line)] == line for f_, o, line in found if f_ == name)
        assert [json.loads(x) for _, _, x in found if x.strip()] == records
    else:
        rows = offsets.scan_line_ranges(spark, path, size).orderBy("file", "offset").collect()
        assert [json.loads(r.line) for r in rows] == records


def test_index_is_stored_and_read_by_seeking(spark, lines, tmp_path, monkeypatch):
    path, records = lines
    index = str(tmp_path / "index")
    offsets.build_index(spark, path, index, {"id": "$.id", "task": "$.task"}, 200)
    entries = offsets.open_index(spark, index, path)
    assert [(r.row, int(r.id), r.task) for r in entries.orderBy("row").collect()] == [(i, x["id"], x["task"]) for i, x in enumerate(records)]
    sources = spark.read.parquet(f"{index}/sources").orderBy("file").collect()
    assert [r.lines for r in sources] == [40, 25, 0] and all(len(r.sha256) == 64 and r.version == 3 for r in sources)
    some = offsets.read_entries(entries.where(F.col("row").isin(0, 7, 8, 9, 39, 64)))
    assert {r.row: json.loads(r.line) for r in some.collect()} == {i: records[i] for i in (0, 7, 8, 9, 39, 64)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "PushedFilters: [In(row" in plan
    #: only the wanted bytes are read
    opened = []
    real = offsets._opened

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, place):
            handle = self.inner.open_input_file(place)

            class Handle:
                def read_at(self, n, at):
                    opened.append((os.path.basename(place), at, n))
                    return handle.read_at(n, at)

                def close(self):
                    handle.close()

            return Handle()

    monkeypatch.setattr(offsets, "_opened", lambda p: (Watched(real(p)[0]), real(p)[1]))
    wanted = entries.where("row in (45, 46, 60)").toArrow().to_batches()
    got = [x for b in offsets._fetched(iter(wanted)) for x in b.column("line").to_pylist()]
    assert sorted(json.loads(x)["id"] for x in got) == [105, 106, 120]
    assert [f for f, _, _ in opened] == ["b.jsonl"] * 2 and sum(n for _, _, n in opened) <= sum(map(len, got)) + 2


def test_a_changed_file_is_refused(spark, lines, tmp_path):
    path, _ = lines
    index = str(tmp_path / "index")
    offsets.build_index(spark, path, index, {})
    assert offsets.changed_files(spark, index, path).count() == offsets.changed_files(spark, index, path, content=True).count() == 0
    with open(f"{path}/b.jsonl", "r+b") as f:  # as many bytes, other content
        f.seek(3)
        f.write(b"?")
    os.utime(f"{path}/b.jsonl", ns=(1, 1))
    with pytest.raises(ValueError, match="stale index.*b.jsonl .changed"):
        offsets.open_index(spark, index, path)
    assert [r.problem for r in offsets.changed_files(spark, index, path, content=True).collect()] == ["sha256"]
    with open(f"{path}/d.jsonl", "w") as f:
        f.write("{}\n")
    os.remove(f"{path}/c.jsonl")
    assert {(os.path.basename(r.file), r.problem) for r in offsets.changed_files(spark, index, path).collect()} == {("b.jsonl", "changed"), ("c.jsonl", "gone"), ("d.jsonl", "new")}


@pytest.mark.parametrize("bad", ["[1]", "{broken", "7"])
def test_a_line_that_is_no_object_fails_the_build(spark, tmp_path, bad):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n' + bad + "\n")
    with pytest.raises(Exception, match="not a JSON object"):
        offsets.build_index(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "index"), {"id": "$.id"})


def test_row_ranges_move_no_rows(spark, tmp_path):
    path = str(tmp_path / "with space")
    spark.range(0, 1000, 1, 7).select("id", F.lit("x").alias("position_")).write.parquet(path)
    files = offsets.numbered_files(spark, path).orderBy("start").collect()
    assert len(files) == 7 and sum(r.n for r in files) == 1000
    for low, high in ((0, 5), (140, 146), (100, 700), (999, 2000), (0, 1000), (5000, 6000), (7, 7)):
        got = offsets.read_row_range(spark, path, low, high, ["id"])
        rows = sorted((r.position, r.id) for r in got.collect())
        assert rows == [(i, i) for i in range(low, min(high, 1000))]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("BroadcastExchange")
    few = offsets.read_row_range(spark, path, 10, 20)
    assert few.columns == ["id", "position_", "position"] and len(few.inputFiles()) == 1
