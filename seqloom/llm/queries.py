"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import exact_dedup, html_text, merkle, minhash, mixing, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_rules, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_minhash": minhash.op3_minhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
    "op11_url_rules": url_rules.op11_url_rules,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_sharding": sharding.SQL,
    "op11_url_rules": url_rules.SQL,
    "op13_merkle": merkle.SQL,
}
