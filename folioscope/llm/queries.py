"""The operators' queries and their SQL twins."""

from folioscope.llm import (
    chat, decontamination, divergence, importance, jaccard_join, licenses, line_dedup, mixing, personal_data, quality,
    token_counts, token_ids, toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op3_decontamination": decontamination.op3_decontamination,
    "op2_quality": quality.op2_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_token_ids": token_ids.op6_token_ids,
    "op7_chat": chat.op7_chat,
    "op8_licenses": licenses.op8_licenses,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_personal_data": personal_data.op10_personal_data,
    "op11_importance": importance.op11_importance,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_importance": importance.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
