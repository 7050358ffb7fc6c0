"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from quarry.llm import (
    fingerprint, html_text, merkle, mixing, packing, periodic, pitman_yor, prob_minhash, projections, quality, sharding, suffix_dedup, token_files,
)

QUERIES = {
    "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_lm_scoring": pitman_yor.op3_lm_scoring,
    "op4_collision_projections": projections.op4_collision_projections,
    "op5_temperature_mixing": mixing.op5_temperature_mixing,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_minhash_near_dedup": prob_minhash.op10_minhash_near_dedup,
    "op11_lpt_sharding": sharding.op11_lpt_sharding,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op5_temperature_mixing": mixing.OP5_SQL, "op11_lpt_sharding": sharding.OP11_SQL,
                           "op12_merkle_manifest": merkle.OP12_SQL}
