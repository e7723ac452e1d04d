"""Cross-tokenizer alignment against a token-by-token version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__
from sluice.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " lead  double   spaces \n\n tab\t end "), (5, "<|endoftext|> is text, <s> too"),
    (6, "▁ a piece's own blank"), (7, "naïve café — 漢字かな 🙂🙂 x" + "é" * 50), (8, "0123456789" * 40), (9, "hyper" * 300), (10, "\n"), (11, "a"), (None, "no id"), (12, "\x00\x01 control"), (13, "aaaa" * 2000),
]


def byte_map():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens_of(rows):
    """Per row ([(A id, bytes)], [(B id, bytes)]), none where the bytes differ."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = byte_map()
    for doc, text in rows:
        if not text:
            yield doc, [], []
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(of[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        two = []
        for i, p in zip(b.encode(text), b.encode(text, out_type=str)):
            two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        fine = b"".join(x for _, x in one) == want == b"".join(x for _, x in two)
        yield (doc, one, two) if fine else (doc, [], [])


def brute(rows):
    found, counts = [], Counter()
    for doc, one, two in tokens_of(rows):
        ends_a = np.cumsum([len(x) for _, x in one]).tolist()
        ends_b = np.cumsum([len(x) for _, x in two]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, start = [], 0
        for cut in cuts:
            groups.append(([i for (i, _), e in zip(one, ends_a) if start < e <= cut], [i for (i, _), e in zip(two, ends_b) if start < e <= cut]))
            start = cut
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(links.keys())
        found.append((doc, one, two, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc, one, two, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((doc, len(one), len(two), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if one else ""))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def short(spark, sf):
    """The table's texts of up to 4,000 characters: the token-by-token version is slow."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") <= 4000]


@pytest.mark.parametrize("held", [alignment.HELD, 500, 0])
def test_alignment_of_documents(spark, sf, held):
    rows = short(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.alignment(docs, *alignment.default_tokenizers(), held=held)) == brute(rows)


def test_alignment_of_odd_texts(spark):
    docs = spark.createDataFrame([(t, d, 1) for d, t in ODD], "text string, DOC_ID long, `Pairs` int")
    assert rows_of(alignment.alignment(docs, *alignment.default_tokenizers())) == brute(ODD)
    assert rows_of(alignment.alignment(docs.limit(0), *alignment.default_tokenizers())) == []


def test_overlaps_are_consecutive_owner_pairs():
    pair_a, pair_b, group_a, group_b = alignment.owners(np.array([2, 2, 1]), np.array([1, 3, 1]))
    assert list(zip(pair_a.tolist(), pair_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 0, 1]


def test_large_groups_are_linked_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(5)
    group_a, group_b = np.sort(rng.integers(0, 4, 200)), np.sort(rng.integers(0, 4, 300))
    ids_a, ids_b, doc_of = rng.integers(0, 9, 200), rng.integers(0, 9, 300), np.array([0, 0, 1, 1])
    plain = Counter((int(doc_of[g]), int(x) << 32 | int(y)) for x, g in zip(ids_a, group_a) for y, h in zip(ids_b, group_b) if g == h)
    for small in (0, 1 << 40):
        monkeypatch.setattr(alignment, "SMALL", small)
        doc, pair, n = alignment.linked(ids_a, group_a, ids_b, group_b, doc_of)
        assert dict(zip(zip(doc.tolist(), pair.tolist()), n.tolist())) == plain


def test_query_runs_over_the_whole_table(spark, sf):
    got = __spark_entry__.queries()["op13_alignment"](spark, sf)
    assert got.columns[:8] == COLUMNS and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
