"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

import corpus_pipeline
from treeloom.llm import bpe, decontamination, html_extraction, jaccard_join, lm_scoring, merkle, pii, quality_rules, sharding, token_counts, toxicity, url_rules, whitening

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_quality_rules": quality_rules.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_url_rules": url_rules.query,
    "op5_html_extraction": html_extraction.query,
    "op6_byte_sharding": sharding.query,
    "op7_token_counts": token_counts.query,
    "op8_bpe_coding": bpe.query,
    "op9_toxicity": toxicity.query,
    "op10_ngram_jaccard_join": jaccard_join.query,
    "op11_merkle_manifest": merkle.query,
    "op12_pii_anchors": pii.query,
    "op13_embedding_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.ORACLE_SQL,
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op3_lm_scoring": lm_scoring.ORACLE_SQL,
    "op4_url_rules": url_rules.ORACLE_SQL,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
}
