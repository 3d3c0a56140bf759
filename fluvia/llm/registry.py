"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fluvia.llm import alignment, bpe, clicks, exact_dedup, licenses, neighbours, ngram_join, packing, pii, quality, secrets, store, substrings

SQL: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL, "op6_secret_scan": secrets.SQL, "op12_vantage_point_search": neighbours.SQL}


def queries() -> dict:
    return {f.__name__: f for f in (substrings.op1_substring_dedup, licenses.op2_license_scan, ngram_join.op3_ngram_join, exact_dedup.op4_exact_dedup, quality.op5_quality_rules, secrets.op6_secret_scan, pii.op7_pii, store.op8_content_store, bpe.op9_byte_bpe, packing.op10_best_fit_packing, clicks.op11_click_windows, neighbours.op12_vantage_point_search, alignment.op13_cross_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
