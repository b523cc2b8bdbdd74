"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from cadenza.llm.chat_format import OP2_SQL, op2_chat_formatting
from cadenza.llm.conversation_repair import OP13_SQL, op13_conversation_structure_repair
from cadenza.llm.decontamination import OP3_SQL, op3_benchmark_decontamination
from cadenza.llm.filter_audit import OP11_SQL, op11_filter_interaction_audit
from cadenza.llm.html_extraction import op7_html_extraction
from cadenza.llm.language_id import op8_language_id
from cadenza.llm.maxscore import OP5_SQL, op5_exact_top_k
from cadenza.llm.packing import op10_packing
from cadenza.llm.simhash import op4_simhash_near_dedup
from cadenza.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from cadenza.llm.suffix_dedup import OP6_SQL, op6_suffix_array_dedup
from cadenza.llm.token_counts import op12_token_counts
from cadenza.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_structure_repair": op13_conversation_structure_repair,
}

SQL: dict[str, str] = {
    "op2_chat_formatting": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op6_suffix_array_dedup": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_filter_interaction_audit": OP11_SQL,
    "op13_conversation_structure_repair": OP13_SQL,
}
