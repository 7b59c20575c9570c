"""The opN_ queries, each an operator with production parameters over its whole table."""

from __future__ import annotations

from . import conversations, decontaminate, langid, line_dedup, merkle, minhash, packing, quality, secrets, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
