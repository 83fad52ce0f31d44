"""The queries of the training-data operators."""

from __future__ import annotations

from . import conversation, decontamination, filteraudit, jaccard, linededup, neighbours, packing, quality, sharding, simhash, substrings, tokenfile, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_conversation_repair": conversation.op11_conversation_repair,
    "op12_simhash": simhash.op12_simhash,
    "op13_filter_audit": filteraudit.op13_filter_audit,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_packing": packing.op7_packing,
    "op8_token_ids": tokenfile.op8_token_ids,
    "op9_substring_dedup": substrings.op9_substring_dedup,
}
ORACLES: dict[str, str] = {"op2_decontamination": decontamination.OP2_SQL, "op5_line_dedup": linededup.OP5_SQL, "op9_substring_dedup": substrings.OP9_SQL, "op10_jaccard_join": jaccard.OP10_SQL, "op11_conversation_repair": conversation.OP11_SQL, "op13_filter_audit": filteraudit.OP13_SQL}
