"""The registered queries of this subpackage and their SQL answers."""

from __future__ import annotations

from riskloom.llm import bpe, chat, decontaminate, hilbert, html, lines, middle, quality, runs, simhash, substrings, topk, urls

QUERIES = {
    "op1_suffix_dedup": substrings.op1_suffix_dedup,
    "op2_pu_quality": quality.op2_pu_quality,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_chat_round_trip": chat.op5_chat_round_trip,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_html_min_cut": html.op7_html_min_cut,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_hilbert_shards": hilbert.op10_hilbert_shards,
    "op11_fill_in_middle": middle.op11_fill_in_middle,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_url_filter": urls.op13_url_filter,
}
ORACLES = {
    "op1_suffix_dedup": substrings.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op5_chat_round_trip": chat.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_fill_in_middle": middle.ORACLE,
    "op13_url_filter": urls.ORACLE,
}
