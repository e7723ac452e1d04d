"""Packing and token counts against the library and first principles."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing, token_counts
from sluice.llm.bpe import ByteBpe

ODD = ["", None, " a  b", "a.b 12,3 'tis it's\nIt's<|endoftext|> x", "x\n", "\n", "é.è ç, 中文 text. b", "a...b ,, .a !?", "...\n ...", "don't,you're.I'll|we", "a b c　d", "tab\tand\r\nline", "ab " * 3000, "Éa ǅ İstanbul ΣΑΣ", "<|STARTOFTEXT|> q", "\x1f\x1c x", "é x"]


@pytest.fixture(scope="module")
def coder():
    return ByteBpe(*packing.default_tokenizer())


@pytest.fixture(scope="module")
def counter():
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.Counter(path, token_counts.whole_tokens(path))


def test_ids_equal_the_library(coder):
    for text, ids in zip(ODD, coder.encode(pa.array(ODD, pa.string()))):
        assert ids.tolist() == coder.whole(text or "").tolist(), text


def test_ids_equal_the_library_on_documents(coder, sf):
    texts = pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    for text, ids in zip(texts, coder.encode(pa.array(texts))):
        assert ids.tolist() == coder.whole(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab zé.,'\n\t<|>01Σ中́")), max_size=30), max_size=5))
def test_ids_and_counts_equal_the_library_on_any_text(coder, counter, texts):
    array = pa.array(texts, pa.string())
    assert [x.tolist() for x in coder.encode(array)] == [coder.whole(t).tolist() for t in texts]
    assert counter.count(array).tolist() == [counter.one(t) for t in texts]


def test_whole_tokens_are_proved(counter):
    some = sorted(counter.whole)[::500]
    assert all(counter.one(t) == 1 for t in some) and len(counter.whole) > 10_000


def test_token_counts_query(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (0, "")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, id string, n_tokens int")
    got = token_counts.token_counts(df, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_bytes, got.n_tokens, got.over_limit)) == expected
    assert token_counts.token_counts(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_is_gapless_and_complete(lengths):
    sizes = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bins, offsets = packing.pack_lengths(sizes, 64)
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == [0, *np.cumsum(sizes[at])[:-1]] and sizes[at].sum() <= 64


def test_sum_of_squares_takes_the_least_change():
    sizes = [30, 20, 44, 14, 33, 20]
    bins, _ = packing.sum_of_squares(np.array(sizes), 64)
    count, gaps = {}, {}
    for size, b in zip(sizes, bins.tolist()):
        options = {}
        for gap in {64, *[g for g in gaps.values() if g >= size]}:
            trial = dict(count)
            if gap != 64:
                trial[gap] -= 1
            if gap - size:
                trial[gap - size] = trial.get(gap - size, 0) + 1
            options[gap] = sum(n * n for n in trial.values())
        used = gaps.get(b, 64)
        assert options[used] == min(options.values())
        if used != 64:
            count[used] -= 1
        gaps[b] = used - size
        if gaps[b]:
            count[gaps[b]] = count.get(gaps[b], 0) + 1


def test_packing_query(spark, coder):
    texts = [*ODD, "word " * 5000, "same", "same", "b " * 2047, "b " * 2048]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] + [(3, ODD[3], "x", 5), (None, "y", "x", 5)], "doc_id long, text string, id string, piece int")
    got = packing.best_fit_packing(df, packing.default_tokenizer()).toPandas()
    for i, text in enumerate(texts):
        ids = np.append(coder.whole(text or ""), 0).astype("<u4")
        rows = got[got.doc_id == i].drop_duplicates(["piece"]).sort_values("piece")
        assert rows.length.sum() == len(ids) and rows.length.max() <= 2048 and (rows.length.iloc[1:] == 2048).all()
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
    assert len(got[got.doc_id == 3]) == 2 and got.doc_id.isna().sum() == 1
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert packing.best_fit_packing(df.limit(0), packing.default_tokenizer()).count() == 0


def test_packing_is_near_the_bound(spark, sf):
    got = packing.op1_best_fit_packing(spark, sf).toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.03 + 2


def test_shards_are_packed_apart(spark):
    df = spark.createDataFrame([(i, 0, 1 + i % 700) for i in range(500)], "doc_id long, piece int, length long")
    got = packing.pack(df, 1000, shard_pieces=60).toPandas()
    assert len(got) == 500 and got.groupby("sequence_id").length.sum().max() <= 1000
    assert (got.sequence_id // (1 << 32)).nunique() > 4
