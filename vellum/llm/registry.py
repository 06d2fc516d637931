"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from . import bpe, exact_dedup, jaccard_join, language_id, nearest, packing, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_nearest": nearest.query,
    "op3_url_filter": url_filter.query,
    "op4_token_counts": token_counts.query,
    "op5_toxicity": toxicity.query,
    "op6_packing": packing.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_token_files": token_files.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_bpe": bpe.query,
}

ORACLE_SQL = {"op7_exact_dedup": exact_dedup.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE}
