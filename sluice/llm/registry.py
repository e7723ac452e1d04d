"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from sluice.llm.alignment import op13_alignment
from sluice.llm.ann import op5_ann
from sluice.llm.decontaminate import op7_decontamination
from sluice.llm.hmm import op2_hmm_scoring
from sluice.llm.line_dedup import OP12_SQL, op12_line_dedup
from sluice.llm.packing import op1_best_fit_packing
from sluice.llm.pii import op10_pii
from sluice.llm.resampling import op11_resampling
from sluice.llm.simhash import op8_simhash_dedup
from sluice.llm.suffix_dedup import op6_suffix_dedup
from sluice.llm.token_counts import op3_token_counts
from sluice.llm.toxicity import op4_toxicity
from sluice.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_hmm_scoring": op2_hmm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_ann": op5_ann,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_line_dedup": op12_line_dedup,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op9_url_filter": OP9_SQL, "op12_line_dedup": OP12_SQL}
