"""The end token where it is not among the frequent words."""

import math

import pytest
from pyspark.sql import functions as F

from sluice.llm import hmm


def test_end_counts_when_it_is_rare(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 3)
    monkeypatch.setattr(hmm, "SYMBOLS", 2)
    row = hmm.hmm_scores(spark.createDataFrame([(1, "a a b b c c d")], "doc_id long, text string"), F.lit(False)).first()
    n, v = 8, 5
    assert row.n_known == 8
    assert row.base_score == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (2, 2, 2, 2, 2, 2, 1, 1)))
