"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from hornpress.llm import bpe, chat, exact_dedup, media, mixing, quality, sharding, simhash, token_counts, url_filter

QUERIES = {
    "op1_media": media.op1_media,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_chat": chat.op3_chat,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op2_url_filter": url_filter.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
