"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from factloom.llm import ann, exact_dedup, langid, lm, minhash, packing, pii, piece_codec, secrets, urlfilter

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_piece_codec": piece_codec.query,
    "op3_pii": pii.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_langid": langid.query,
    "op6_lm": lm.query,
    "op7_url_filter": urlfilter.query,
    "op8_minhash": minhash.query,
    "op9_nearest": ann.query,
    "op10_packing": packing.query,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_minhash": minhash.ORACLE,
}
