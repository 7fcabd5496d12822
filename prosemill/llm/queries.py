"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, language_model, licenses, mixing, quality, repetition, sharding, simhash, substring, toxicity

QUERIES = {
    "op1_simhash_neardup": simhash.op1_simhash_neardup,
    "op2_hilbert_shards": sharding.op2_hilbert_shards,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_repetition_rules": repetition.op4_repetition_rules,
    "op5_quality_cotraining": quality.op5_quality_cotraining,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_stupid_backoff": language_model.op10_stupid_backoff,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op3_substring_dedup": substring.OP3_SQL,
    "op4_repetition_rules": repetition.OP4_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op10_stupid_backoff": language_model.OP10_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
