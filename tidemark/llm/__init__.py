"""Corpus operators for training data, their queries and the SQL these are checked against."""

from tidemark.llm import best_fit, chat_repair, decontaminate, jaccard_join, licenses, line_dedup, merkle, outliers, packing, private_data, suffix_dedup, toxicity, turn_alignment

_MODULES = {
    "op1_outliers": outliers,
    "op2_toxicity": toxicity,
    "op3_suffix_dedup": suffix_dedup,
    "op4_packing": packing,
    "op5_decontaminate": decontaminate,
    "op6_licenses": licenses,
    "op7_line_dedup": line_dedup,
    "op8_private_data": private_data,
    "op9_chat_repair": chat_repair,
    "op10_jaccard_join": jaccard_join,
    "op11_merkle": merkle,
    "op12_turn_alignment": turn_alignment,
    "op13_best_fit": best_fit,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
