"""Registration of queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def json_text(value: str) -> str:
    """DuckDB SQL for a string in canonical JSON."""
    plain, n = r"[ -!#-\[\]-~]", "unicode(p)"
    named = " ".join(f"WHEN {code} THEN '{text}'" for code, text in {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r", 34: r"\"", 92: "\\\\"}.items())
    wide = rf"printf('\u%04x\u%04x', 55296 + (({n} - 65536) >> 10), 56320 + (({n} - 65536) & 1023))"
    each = rf"CASE WHEN regexp_matches(p, '^{plain}') THEN p WHEN {n} > 65535 THEN {wide} ELSE CASE {n} {named} ELSE printf('\u%04x', {n}) END END"
    found = rf"regexp_extract_all({value}, '{plain}+|[^ -!#-\[\]-~]')"
    return f"coalesce('\"' || array_to_string(list_transform({found}, lambda p: {each}), '') || '\"', 'null')"


def json_object(**values: str) -> str:
    """DuckDB SQL for an object: SQL text of each value's JSON by name."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {values[k]}" for k in sorted(values)) + " || '}'"


class Tables:
    """The parquet tables of a directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with SQL for the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register
