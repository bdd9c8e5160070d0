"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from spanweave.llm import chat, conversation_repair, decontaminate, language_model, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, spelling, token_counts, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat": chat.op6_chat,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_lm_scoring": language_model.op10_lm_scoring,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLE_SQL = {"op1_line_dedup": line_dedup.OP1_SQL, "op6_chat": chat.OP6_SQL}
