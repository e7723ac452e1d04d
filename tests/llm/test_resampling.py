"""Importance resampling against a version that lists every feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import __spark_entry__
from sluice.llm import resampling

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "One two"), (4, "One two"), (5, "a b c " * 30), (6, "ünïcode ÜNÏ 漢字 漢字 e-mail's x_y `q` {z}~"), (7, "w" * 5000 + " end"),
    (None, "no id but more than twenty words of text are here so that it may be drawn with all of the others that are"), (8, "42 " * 25), (9, "\x00a\x7fb\x80c"), (10, " ".join(map(str, range(300)))),
]


def features(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for doc, text in rows:
        words, grams = features(text)
        h = int(hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in grams)
        out.append([doc, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(__spark_entry__.queries()["op11_resampling"](spark, sf))
    assert got == brute(docs, target)
    assert sum(r[4] is not None for r in got) > 0


def test_odd_texts_and_tables(spark):
    rows = ODD + [(100 + i, f"{i} " + "many words " * 12) for i in range(60)]
    docs = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, DOC_ID long, _place string").repartition(3)
    target = spark.createDataFrame([("A b c",), (None,)], "text string")
    assert rows_of(resampling.resample(docs, target)) == brute(rows, ["A b c", None])
    assert rows_of(resampling.resample(docs, target.limit(0))) == brute(rows, [])
    assert rows_of(resampling.resample(docs.limit(0), target)) == []


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 7, 8, 40, 40, 60])
    for high in (3, 1 << 40):  # ids that fit one packed number, and ids that do not
        ids = rng.integers(0, 3, 60) * (high // 3)
        order, common, left = resampling.suffix_order(ids, first)
        stop = np.repeat(first[1:], np.diff(first))
        suffix = [tuple(ids[i : min(i + 3, stop[i])].tolist()) for i in range(60)]
        assert [suffix[i] for i in order] == sorted(suffix)
        assert left.tolist() == [len(s) for s in suffix]
        for k in range(1, 60):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_one_sum_per_run_is_that_of_every_occurrence():
    texts = pa.array(["to be or not to be", "not to be " + "y" * 3000 + " or not", "", None])
    features_ = resampling.Features(1 << 20)
    grams, first = features_.block(texts)
    ids, words, _ = resampling.words_of(texts)
    for n, (at, bucket) in enumerate(grams, 1):
        assert len(at) == sum(max(k - n + 1, 0) for k in np.diff(first))
        for p, b in zip(at, bucket):
            assert b == zlib.crc32(b" ".join(words[i] for i in ids[p : p + n])) % (1 << 20)
