"""The corpus queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from clientlens.llm import (
    bpe, exact_dedup, interpolated_lm, jaccard_join, merkle_manifest, packing, passage_dedup, periodic_runs, quality_classifier, quality_rules,
    secret_scan, substring_dedup, toxicity)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_suffix_dedup": substring_dedup.op3_suffix_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_secret_scans": secret_scan.op5_secret_scans,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_lm_scoring": interpolated_lm.op8_lm_scoring,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_passage_dedup": passage_dedup.op13_passage_dedup,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "op13_passage_dedup": passage_dedup.OP13_SQL,
}
