"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, divergence, exact_dedup, language_id, minhash, mixing, nearest, packing, personal_data, quality, secrets, suffix_dedup, token_counts

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op8_mixing": mixing.op8_mixing,
    "op7_nearest_neighbours": nearest.op7_nearest_neighbours,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_secret_scan": secrets.op13_secret_scan,
}
ORACLES = {**exact_dedup.ORACLE, **centroids.ORACLE, **divergence.ORACLE}
