"""Suffix dedup and SimHash groups against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import components, simhash, suffix_dedup


def brute_repeats(texts, length):
    seen, data = {}, [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for b, g in zip(data, gone):
        edges = np.diff(np.concatenate([[0], g.astype(int)]))
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((len(b), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, texts, length):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid int, mini string")
    got = suffix_dedup.suffix_dedup(df, length).toPandas().sort_values("doc_id")
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == brute_repeats(texts, length)


@pytest.fixture(scope="module")
def prose(sf):
    return [t for t in pd.read_parquet(f"{sf}/documents.parquet").text if t]


def test_repeats_in_documents(spark, prose):
    p = prose[3][:900]
    more = [None, "", "a" * 900, "ab" * 500, prose[5][100:480] + "zz" + prose[5][100:520], p[:450] + "Q" + p[450:], "xyz " + p[10:430] + " end", "more " + p[20:440] + "!!", prose[2][:1500] + prose[2][200:900], "é" * 300]
    check_repeats(spark, prose[:40] + more, 400)


def test_repeats_of_small_alphabets(spark):
    rng = random.Random(1)
    check_repeats(spark, ["".join(rng.choice("ab") for _ in range(rng.randint(0, 250))) for _ in range(30)], 24)


@pytest.mark.parametrize("common", [2, 2048])
def test_repeats_around_a_common_line(spark, prose, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    line = prose[7][:380]
    check_repeats(spark, [prose[i][:300] + line + prose[i + 1][:300] for i in range(20)] + [prose[i][:50] + line + prose[40][: 30 + i] for i in range(15)], 400)


def test_no_collection_outgrows_its_bound(spark, prose, monkeypatch):
    """A line that many texts share in different places, cut block by block down to single windows."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    seen, build = [], suffix_dedup._build
    monkeypatch.setattr(suffix_dedup, "_build", lambda groups, length: seen.append(groups.groupBy("key").count().agg({"count": "max"}).first()[0]) or build(groups, length))
    line = prose[7][:470]
    check_repeats(spark, [prose[i][:300] + line + prose[i + 1][:300] for i in range(20)] + [f"{i} " + line[: 380 + 3 * i] + f"{i}" * 40 for i in range(30)], 400)
    assert seen[0] is None or seen[0] <= 3


def test_repeats_with_columns_in_a_file(spark, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 0)
    held = [prose[4][:600] + "!", "?" + prose[4][:600], prose[4][50:600]]
    found = suffix_dedup.repeated_windows(np.zeros(3, np.int64), [t.encode()[:500] for t in held], np.array([1, 0, 51]), 300)
    assert found


def test_repeats_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "z" * 450), (1, "z" * 450), (None, "q" * 10)], "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, 400, texts=True).toPandas()
    assert sorted(got.n_removed) == [0, 450, 450] and got[got.doc_id.isna()].kept.iloc[0] == b"q" * 10
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=2, max_size=12))
def test_column_rounds_find_equal_windows(texts):
    texts = [t for t in dict.fromkeys(texts) if len(t) >= 5]
    if len(texts) < 2:
        return
    data = [t.encode() for t in texts]
    got = set(suffix_dedup.repeated_windows(np.zeros(len(data), np.int64), data, np.zeros(len(data), np.int64), 5))
    want = {(d, i) for d, b in enumerate(data) for i in range(len(b) - 4) if any(o[i : i + 5] == b[i : i + 5] for k, o in enumerate(data) if k != d)}
    assert got == want


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_of(values, ids, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark, prose):
    rng = random.Random(3)
    base = prose[:40] + [None, "", "One", "one ", "a b", " a\tB\x0b", "x " * 700, "É é à", " nbsp"]
    near = []
    for t in prose[:12]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    texts = base + near + prose[:5]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, h string")
    got = simhash.near_duplicates(df).toPandas().set_index("doc_id")
    values = [brute_fingerprint(t) for t in texts]
    assert all(int(got.fp[i]) % (1 << 64) == v for i, v in enumerate(values))
    assert got.component_id.to_dict() == components_of(values, list(range(len(texts))))


def test_links_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", 4)
    rng = random.Random(5)
    values = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            values.append(x)
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
    values = list(dict.fromkeys(v & ((1 << 64) - 1) for v in values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = components.connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    got = {v: v for v in signed} | {r.v: r.root for r in roots}
    want = components_of([v % (1 << 64) for v in signed], signed)
    group = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert group(got) == group(want)


def test_large_cells_are_parted_without_loss():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 13, 6000).astype(np.uint64))
    v, r = simhash.link_cell(values, 3)
    assert len(set(values.tolist()) - set(v.tolist())) == 1


def test_bit_majority_beyond_255(spark):
    hashes = np.array([1] * 300 + [3] * 299 + [2] * 2, dtype=np.uint64)
    assert simhash.bit_majority(hashes, np.array([0, 599, 599, 601])).tolist() == [1, 0, 2]


def test_first_of_groups_keeps_one_row(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (2, "a b c d", 6), (None, "q r s t", 7), (None, "q r s t", 7), (4, None, 8), (5, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = simhash.first_of_groups(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "None"]
    assert simhash.first_of_groups(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_forget_removes_kept_tables(spark):
    from sluice.llm import store

    kept = store.keep(spark.range(3), "some")
    assert kept.count() == 3
    suffix_dedup.with_row_ids(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    store.forget(spark)
    assert not spark.catalog.listTables(pattern="sluice_texts_*")
    with pytest.raises(Exception):
        kept.count()
