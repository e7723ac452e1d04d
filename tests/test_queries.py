"""Every query of the library's own operators against DuckDB on the same files."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from sluice import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def normal(value):
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.5f}"
    return f"{float(value):.5f}" if isinstance(value, int) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([normal(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    found = duck.execute(registry.ORACLE_SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in found.description], found.fetchall())


def test_epoch_blocks_are_exact_and_unique_within_a_block(spark, duck, sf):
    rows = registry.QUERIES["epoch_stream_blocks"](spark, sf).toPandas()
    sizes = dict(duck.execute("select lang, count(*) from documents group by 1").fetchall())
    assert len(rows) == sum(16 * math.ceil(n * 3.5 / 16) for n in sizes.values())
    for task, part in rows.groupby("task"):
        if sizes[task] >= 16:
            assert not part.duplicated(["step", "row_index"]).any()
        counts = part.row_index.value_counts()
        assert len(counts) == sizes[task] and counts.max() - counts.min() <= 1


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_a_function_of_session_and_folder():
    assert set(registry.ORACLE_SQL) <= set(__spark_entry__.queries())


def test_the_rest_does_not_import_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, names in os.walk(os.path.join(root, "sluice")):
        if os.path.relpath(folder, root).startswith(os.path.join("sluice", "llm")):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "sluice.llm" not in f.read(), name
