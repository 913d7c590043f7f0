"""The queries of this folder: name to (query, SQL or None)."""

from __future__ import annotations

from evispark.llm import bpe, chat, embedding_dedup, exact_dedup, mixing, near_dedup, periods, prefix_trie, quality, substring, token_counts, topk, url_filter

QUERIES = {
    "op1_minhash_near_dedup": (near_dedup.op1_minhash_near_dedup, None),
    "op2_url_filter": (url_filter.op2_url_filter, None),
    "op3_exact_topk": (topk.op3_exact_topk, topk.OP3_SQL),
    "op4_byte_bpe": (bpe.op4_byte_bpe, None),
    "op5_mixing": (mixing.op5_mixing, None),
    "op6_quality": (quality.op6_quality, None),
    "op7_chat_formatting": (chat.op7_chat_formatting, chat.OP7_SQL),
    "op8_substring_dedup": (substring.op8_substring_dedup, None),
    "op9_exact_dedup": (exact_dedup.op9_exact_dedup, exact_dedup.OP9_SQL),
    "op10_token_counts": (token_counts.op10_token_counts, None),
    "op11_prefix_trie": (prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL),
    "op12_periodic_runs": (periods.op12_periodic_runs, None),
    "op13_embedding_near_dedup": (embedding_dedup.op13_embedding_near_dedup, None),
}
