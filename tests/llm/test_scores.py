"""Scores of the query against a plain recursion, token by token."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import hmm


def test_scores_equal_a_plain_forward_recursion(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 6)
    monkeypatch.setattr(hmm, "KNOWN", 9)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(1 + i % 5)) for i in range(40)]
    texts = [" ".join(rng.choice(words[: 5 + i]) for _ in range(i * 3)) for i in range(30)] + [None, "", "never seen WORDS here", "x" * 5000 + " a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []

    def fixed(training, size, background):
        """A random model: what is tested is scoring."""
        gen = np.random.default_rng(3)
        one = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(gen.uniform(0.1, 1, shape))
        made.append(hmm.Hmm(one(3), one(3, 3), one(3, size).T.copy()))
        return made[0]

    monkeypatch.setattr(hmm, "trained", fixed)
    got = {r.doc_id: r for r in hmm.hmm_scores(docs, F.col("doc_id") % 4 == 1).collect()}
    split = lambda t: [w.lower().encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [b""]
    counts = Counter(w for i, t in enumerate(texts) if i % 4 != 1 for w in split(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    octave = lambda c: math.floor(math.log2(c) * 16)
    known = [w for w in ranked if sum(octave(counts[v]) >= octave(counts[w]) for v in counts) <= 9]
    n_sym = min(6, len(known))
    symbol = {w: i for i, w in enumerate(known[:n_sym])}
    in_class = Counter(), Counter()
    for w, c in counts.items():
        if w and w not in symbol:
            in_class[0][hmm.class_of(w)] += c
            in_class[1][hmm.class_of(w)] += 1
    n, v = sum(counts.values()), len(counts)
    model = made[0]
    for i, text in enumerate(texts):
        tokens, log, alpha = split(text), 0.0, None
        for w in tokens:
            k = None if w in symbol or not w else hmm.class_of(w)
            s = symbol.get(w, n_sym if not w else n_sym + 1 + (k or 0))
            alpha = model.start * model.emit[s] if alpha is None else (alpha @ model.move) * model.emit[s]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if k is not None:
                log += math.log10((counts[w] + 0.5) / (in_class[0][k] + 0.5 * (in_class[1][k] + 1)))
        assert got[i].score == pytest.approx(log, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
