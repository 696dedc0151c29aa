"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from quarryloom.llm import ann, chat, decontaminate, html_extract, line_dedup, mixing, simhash_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_chat_format": chat.op6_chat_format,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_nearest": ann.op9_nearest,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
}

ORACLES = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
}
