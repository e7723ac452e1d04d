"""Canonical JSON against Python's own writer, and keys built on it."""

import datetime
import decimal
import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.canonical import canonical, canonical_columns
from sluice.operators.identity import content_key

TEXTS = ["", "plain", "naïve café", "漢字 🙂\U0010ffff", 'a"b\\c/', "tab\tnew\nline\r\b\f\x00\x1f\x7f\x80\xa0", "~ !#[]", "\\u00e9", "é", " ", None]


def safe(v):
    """What the keys of a record are made of: text, numbers, lists and objects."""
    if v is None or isinstance(v, (str, int, float, bool)):
        return v
    if isinstance(v, dict):
        return {str(k): safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [safe(x) for x in v]
    return str(bytes(v) if isinstance(v, bytearray) else v)


def written(v):
    return json.dumps(safe(v), sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def check(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind)]))
    got = {r.i: r.t for r in df.select("i", canonical(F.col("v"), kind).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [written(v) for v in values]


def test_strings(spark):
    check(spark, T.StringType(), TEXTS)


def test_doubles(spark):
    rng = random.Random(7)
    some = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    some += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 20) for _ in range(2000)] + [round(rng.uniform(0, 1000), rng.randint(0, 6)) for _ in range(2000)]
    some += [2.0**k for k in range(-1074, 1024)]
    some += [0.0, -0.0, 1.0, 0.1, 1e16, 9999999999999998.0, 1e15, 1e-4, 1e-5, 123456789.125, 5e-324, 1.7976931348623157e308, 2.0**-44, 1e23, 2e-3, float("inf"), float("-inf"), None]
    check(spark, T.DoubleType(), [x for x in some if x is None or not math.isnan(x)] + [float("nan")])


def test_floats_are_widened(spark):
    wide = [struct.unpack("<f", struct.pack("<f", x))[0] for x in (0.1, 1 / 3, 16777216.0, 1e-7)]
    check(spark, T.FloatType(), wide)


def test_other_kinds_become_strings(spark):
    check(spark, T.DecimalType(20, 9), [decimal.Decimal(x).quantize(decimal.Decimal("1e-9")) for x in ("1.5", "-0.000000012", "0.000001", "123", "-7.25", "0")])
    check(spark, T.DateType(), [datetime.date(2024, 1, 31), None])
    check(spark, T.TimestampNTZType(), [datetime.datetime(2024, 1, 31, 10), datetime.datetime(2024, 1, 31, 10, 0, 0, 1500)])
    df = spark.sql("SELECT timestamp '2024-01-31 10:00:00.25 UTC' AS v")
    assert df.select(canonical(F.col("v"), T.TimestampType())).first()[0] == '"2024-01-31 10:00:00.250000+00:00"'
    check(spark, T.BinaryType(), [bytearray(b) for b in (b"", b"plain", b"\x00\xff\n\\", b"it's", b"it's \"so\"")])
    check(spark, T.BooleanType(), [True, False, None])
    check(spark, T.ByteType(), [-3, None])


def test_nested(spark):
    kind = T.StructType([
        T.StructField("b", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("z", T.LongType()), T.StructField("é", T.StringType())])))),
        T.StructField("Z", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("a", T.MapType(T.IntegerType(), T.BooleanType())), T.StructField("n", T.MapType(T.BooleanType(), T.StringType())),
    ])
    rows = [
        {"b": {"ü": [{"z": 1, "é": "ü"}, None], "a": None, "Z": []}, "Z": [[1.5, None], None, []], "a": {10: True, 9: None, -1: False}, "n": {True: "x", False: None}},
        {"b": None, "Z": None, "a": {}, "n": None},
        None,
    ]
    check(spark, kind, rows)


def test_content_key_is_the_hash_of_the_written_record(spark):
    rows = [(i, t, {"x": t, "é": "🙂"}, [1.0, None]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, caption string, extra map<string,string>, clip array<double>")
    got = {r.id: r.k for r in df.select("id", content_key(df, "caption", "extra", "clip", "id", two=F.col("id") * 2).alias("k")).collect()}
    for i, t, extra, clip in rows:
        assert got[i] == hashlib.sha256(written({"id": i, "caption": t, "extra": extra, "clip": clip, "two": 2 * i}).encode()).hexdigest()
    assert len(set(got.values())) == len(rows)
    assert df.select(canonical_columns(df, "id")).first()[0].startswith('{"id":')
