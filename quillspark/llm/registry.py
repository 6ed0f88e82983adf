"""The queries of this subpackage and their SQL; a query without SQL is held to a brute-force version in tests/llm."""

from . import bpe, chat, exact_dedup, lexical, near_dedup, negatives, neighbours, packing, pii, quality, repeats, token_files, toxicity

QUERIES = {
    "op1_vp_nearest": neighbours.op1_vp_nearest,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_remove_repeats": repeats.op4_remove_repeats,
    "op5_chat_format": chat.op5_chat_format,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_best_fit_pack": packing.op9_best_fit_pack,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_token_files": token_files.op12_token_files,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES = {
    "op5_chat_format": chat.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
