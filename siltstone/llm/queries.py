"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, html, langid, minhash, quality, secrets, sharding, simple8b

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontam.op3_decontamination,
    "op5_bpe": bpe.op5_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op6_html": html.op6_html,
    "op7_token_blocks": simple8b.op7_token_blocks,
    "op8_minhash": minhash.op8_minhash,
    "op9_chat": chat.op9_chat,
    "op10_sharding": sharding.op10_sharding,
}
SQL = {
    "op2_quality": quality.OP2_SQL,
    "op3_decontamination": decontam.OP3_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
}
