"""The contract queries of this subpackage, and DuckDB's SQL for those that SQL can express."""

from . import decontamination, fill_in_middle, html_extraction, packing, personal_data, quality, simhash_dedup, substring_dedup, suffix_dedup, token_alignment, toxicity, url_filter, vector_search

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup, url_filter.op2_url_filter, quality.op3_quality_classifier, packing.op4_best_fit_packing,
        decontamination.op5_decontamination, toxicity.op6_toxicity, suffix_dedup.op7_suffix_dedup, vector_search.op8_nearest_neighbours,
        html_extraction.op9_html_extraction, simhash_dedup.op10_simhash_dedup, token_alignment.op11_token_alignment, fill_in_middle.op12_fill_in_middle,
        personal_data.op13_personal_data,
    )
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
