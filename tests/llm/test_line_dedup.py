"""Line dedup against a dictionary of lines, and its store of runs."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sluice.llm import line_dedup

LONG = "This line is surely long enough"
ODD = [
    (1, None), (2, ""), (3, "\n"), (4, f"{LONG}\nshort\n{LONG}"), (5, f" \t{LONG.upper()}\r\nother\n"), (6, f"{LONG}"), (7, f"x\n{LONG}\x0b\ny"), (7, f"x\n{LONG}\x0b\ny"), (7, f"also {LONG}"),
    (None, f"{LONG}\nno id"), (None, "twenty code points é\ntwenty code points é"), (8, "twenty code points É"), (9, "twenty code points é"), (10, "twenty code points é"), (11, "a" * 20 + "\n" + "a" * 19), (12, "a" * 20),
    (13, "A" * 20 + "\n" * 5000), (14, " " + "a" * 19), (15, "only twice, so it stays\nq"), (16, "only twice, so it stays"),
]


def brute(rows, min_docs=3, min_chars=20):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    for doc, lines in split:
        for k in {key(x) for x in lines}:
            holders[k].append(doc)
    out = []
    for doc, lines in split:
        kept = []
        for x in lines:
            k = key(x)
            top = max((d for d in holders[k] if d is not None), default=None)
            if not (len(k) >= min_chars and len(holders[k]) >= min_docs and top is not None and (doc is None or doc < top)):
                kept.append(x)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", text).collect()), key=repr)


def test_query_equals_sql_and_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in __spark_entry__.queries()["op12_line_dedup"](spark, sf).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_dedup.OP12_SQL})").fetchall(), key=repr)


@pytest.mark.parametrize("batches", [1, 3, 20])
def test_odd_texts(spark, batches):
    docs = spark.createDataFrame([(t, "x", d) for d, t in ODD], "text string, `_Row` string, doc_id long").repartition(4)
    out = line_dedup.dedup_lines(docs, batches=batches)
    assert out.columns == ["text", "_Row", "doc_id", "n_lines", "n_dropped"]
    assert digest(out) == brute(ODD)
    assert line_dedup.dedup_lines(docs.limit(0), batches=batches).count() == 0


def test_a_line_that_a_third_of_rows_hold(spark, monkeypatch):
    rows = [(i, f"own line of text number {i}\n" + ("the same line in a third of rows" if i % 3 else f"line twice in rows, {i // 2}")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1, 1024):  # looked up by the join alone, and by broadcast
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert digest(line_dedup.dedup_lines(docs)) == brute(rows)


def test_runs_are_disjoint_compacted_and_joined_where_they_lie(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    want = defaultdict(list)
    for k in range(5):
        rows = [(k * 10 + i, f"{h:032d}") for i in range(4) for h in range(k, 40 + i)]
        for doc, h in rows:
            want[h].append(doc)
        store.add(spark.createDataFrame(rows, "doc_id long, h string"))
        held = store._read(store._alive()).where("not hit")
        assert held.count() == held.select("h").distinct().count() == len(want)
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert {r.h: (r.n, r.top) for r in store.repeated(5).collect()} == {h: (len(d), max(d)) for h, d in want.items() if len(d) >= 5}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(store.repeated(5)).count("Exchange") == 0
    assert plan(store.merged(store._alive())).count("Exchange") == 0
    joined = plan(store.joined(spark.createDataFrame([(1, "x")], "doc_id long, h string")))
    assert joined.count("Exchange") == 1 and "SortMergeJoin" in joined
    store.close()
    assert store.repeated(1).count() == 0


def test_no_python_workers_on_the_main_path(spark, sf):
    plan = __spark_entry__.queries()["op12_line_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ABC xyz", "Été É", "ΣΑΣ Σ", "İI", "ǅ ǆ", "Ⅷ Ⓐ", "KELVIN K", "漢字 ABC", "\U00010570 Z", "ẞ ß", "a\nB é", "", "🙂 Q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    assert [r[0] for r in df.select(line_dedup.lowered(F.col("t"))).collect()] == want
