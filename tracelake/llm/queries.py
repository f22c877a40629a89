"""The queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tracelake.llm import ann, chat, decontaminate, jaccard, langid, lines, manifest, mixing, packing, repair, secrets, tokens, toxicity

QUERIES = {
    "op1_tokens": tokens.op1_tokens,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_chat_format": chat.op3_chat_format,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_nearest": ann.op7_nearest,
    "op8_langid": langid.op8_langid,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "op11_manifest": manifest.op11_manifest,
    "op12_packing": packing.op12_packing,
    "op13_repair": repair.op13_repair,
}
ORACLES = {
    "op2_jaccard_join": jaccard.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_manifest": manifest.ORACLE,
}
