"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tendersift.llm import chat, fingerprints, jaccard, mixing, multiindex, neighbours, packing, rulefit, rules, substrings, superminhash, tokens, trie

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_toxicity": neighbours.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": rulefit.op4_quality,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_chat": chat.op8_chat,
    "op9_substrings": substrings.op9_substrings,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": multiindex.op11_hard_negatives,
    "op12_minhash": superminhash.op12_minhash,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {"op3_mixing": mixing.OP3_SQL, "op8_chat": chat.OP8_SQL, "op11_hard_negatives": multiindex.OP11_SQL, "op13_prefix_trie": trie.OP13_SQL}
