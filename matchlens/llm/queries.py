"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import chat, decontaminate, jaccard_join, langid, manifest, mixing, pii, simhash, spelling, stream_dedup, suffix_dedup, token_store, window_index

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_store": token_store.op2_token_store,
    "op3_pii": pii.op3_pii,
    "op4_chat_format": chat.op4_chat_format,
    "op5_mix": mixing.op5_mix,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_window_index": window_index.op9_window_index,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_manifest": manifest.op11_manifest,
    "op12_stream_dedup": stream_dedup.op12_stream_dedup,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_mix": mixing.ORACLE,
    "op9_window_index": window_index.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_manifest": manifest.ORACLE,
    "op12_stream_dedup": stream_dedup.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
