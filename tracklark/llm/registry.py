"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tracklark.llm import op01_jaccard, op02_forest, op03_license, op04_token_counts, op05_quality, op06_line_dedup, op07_repeats, op08_bpe, op09_pii, op10_packing, op11_url_templates, op12_lexical_search, op13_hard_negatives

MODULES = [op01_jaccard, op02_forest, op03_license, op04_token_counts, op05_quality, op06_line_dedup, op07_repeats, op08_bpe, op09_pii, op10_packing, op11_url_templates, op12_lexical_search, op13_hard_negatives]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
