"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import (
    decontaminate, license_scan, line_dedup, minhash_dedup, mixing, periodic_runs, quality_rules, secret_scan, sharding, substring_dedup, suffix_dedup,
    toxicity, vector_codes,
)

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE: dict[str, str] = {
    "op5_minhash_dedup": minhash_dedup.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op2_secret_scan": secret_scan.op2_sql(),
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_license_scan": license_scan.op9_sql(),
    "op10_quality_rules": quality_rules.op10_sql(),
    "op12_periodic_runs": periodic_runs.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
