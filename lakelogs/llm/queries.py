"""The corpus operators as registered queries: name -> callable, and their SQL where SQL can express them."""

from __future__ import annotations

from lakelogs.llm import alignment, decontaminate, divergence, line_dedup, mixing, quality, secrets, sharding, simhash, substring_dedup, suffix_dedup, token_store, url_rules

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality": quality.op4_quality,
    "op5_secrets": secrets.op5_secrets,
    "op6_token_store": token_store.op6_token_store,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": alignment.op11_alignment,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_url_rules": url_rules.op13_url_rules,
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_url_rules": url_rules.ORACLE,
}
