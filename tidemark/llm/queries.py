"""Queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from tidemark.llm import (
    bestfit_packing,
    fingerprints,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    pii,
    quality_rules,
    resampling,
    secret_scan,
    sharding,
    substring_dedup,
    toxicity,
)

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_sharding": sharding.op5_sharding,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_resampling": resampling.op12_resampling,
    "op13_bestfit_packing": bestfit_packing.op13_bestfit_packing,
}

ORACLE_SQL = {
    "op7_quality_rules": quality_rules.oracle(),
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
