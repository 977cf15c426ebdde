"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from cutloom.llm import jaccard_join, knn, licenses, line_dedup, media, mixing, packing, pii, quality_model, rules, spelling, token_counts, vector_codes

QUERIES = {
    "op1_pii_pseudonyms": pii.query,
    "op2_license_scan": licenses.query,
    "op3_quality_classifier": quality_model.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_quality_rules": rules.query,
    "op6_best_fit_packing": packing.query,
    "op7_chroma_fingerprints": media.query,
    "op8_source_mixing": mixing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_token_counts": token_counts.query,
    "op11_voronoi_top_k": knn.query,
    "op12_spelling_variants": spelling.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLE = {
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_voronoi_top_k": knn.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
