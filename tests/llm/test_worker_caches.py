"""Caches of a worker that are emptied while it runs."""

import pyarrow as pa

from sluice.llm import bpe, token_counts


def test_counts_stay_right_when_the_cache_is_emptied(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.Counter(path, token_counts.whole_tokens(path))
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    for texts in (["alpha beta gamma", "delta epsilon zeta"], ["beta alpha eta theta", "iota beta"], ["alpha", "beta zeta eta kappa lambda mu"]):
        assert counter.count(pa.array(texts)).tolist() == [counter.one(t) for t in texts]


def test_ids_stay_right_when_the_cache_is_emptied(monkeypatch):
    from sluice.llm.packing import default_tokenizer

    coder = bpe.ByteBpe(*default_tokenizer())
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    for texts in (["alpha beta gamma", "delta epsilon"], ["beta alpha eta theta", "iota beta"], ["alpha", None, "beta zeta eta kappa"]):
        assert [x.tolist() for x in coder.encode(pa.array(texts))] == [coder.whole(t or "").tolist() for t in texts]
