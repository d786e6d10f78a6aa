"""Queries of this subpackage for the driver's registry: one for each operator, and the pipeline."""

from __future__ import annotations

from . import chat, hyperminhash, images, langid, linededup, merkle, mixing, packing, pii, simhash, sketches, trie, urlfilter

QUERIES = {
    "op1_pii": pii.op1,
    "op2_image_copies": images.op2,
    "op3_chat_formatting": chat.op3,
    "op4_bottom_k_fingerprints": sketches.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_source_mixing": mixing.op6,
    "op7_packing": packing.op7,
    "op8_line_dedup": linededup.op8,
    "op9_language_id": langid.op9,
    "op10_url_filter": urlfilter.op10,
    "op11_hyperminhash": hyperminhash.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_prefix_trie": trie.op13,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
