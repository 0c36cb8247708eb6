"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, convtrie, decontam, exact_dedup, langid, lexical, mixing, packing, pii, secretscan, simhash, toxicity, urlfilter

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
    "op5_language_id": langid.op5_language_id,
    "op6_packing": packing.op6_packing,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_chat_format": chat.op8_chat_format,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_secret_scan": secretscan.op10_secret_scan,
    "op11_prefix_trie": convtrie.op11_prefix_trie,
    "op12_source_mixing": mixing.op12_source_mixing,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op10_secret_scan": secretscan.oracle(),
    "op11_prefix_trie": convtrie.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
