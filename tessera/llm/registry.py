"""Queries of the training-data operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import alignment, bpe_codec, chat, exact_dedup, html_text, lsh_dedup, merkle, packing, pattern_packing, simhash, token_store, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        lsh_dedup.op1_lsh_dedup,
        toxicity.op2_toxicity,
        simhash.op3_simhash,
        exact_dedup.op4_exact_dedup,
        html_text.op5_html_text,
        url_filter.op6_url_filter,
        chat.op7_chat_format,
        token_store.op8_token_store,
        packing.op9_packing,
        bpe_codec.op10_bpe_codec,
        merkle.op11_merkle_manifest,
        pattern_packing.op12_pattern_packing,
        alignment.op13_alignment,
    )
}
ORACLES = {
    "op1_lsh_dedup": lsh_dedup.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
}
