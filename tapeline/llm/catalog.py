"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.alignment import op11_alignment
from tapeline.llm.ann import op4_ann
from tapeline.llm.bpe import op3_bpe
from tapeline.llm.conversations import op13_conversations
from tapeline.llm.decontaminate import op9_decontaminate
from tapeline.llm.html_text import op6_html_text
from tapeline.llm.lang_id import op10_language_id
from tapeline.llm.line_dedup import op5_line_dedup
from tapeline.llm.near_dedup import op1_near_dedup
from tapeline.llm.pieces import op12_pieces
from tapeline.llm.pii import op7_pii
from tapeline.llm.secrets import op8_secrets
from tapeline.llm.token_counts import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_ann": op4_ann,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_text": op6_html_text,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_pieces": op12_pieces,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {}
