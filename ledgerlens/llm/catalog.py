"""Queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .collocations import OP12_SQL, op12_collocations
from .decontamination import op1_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extraction import op10_html_extraction
from .language_id import op9_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import op5_ngram_join
from .quality_rules import op11_quality_rules
from .sharding import op6_sharding
from .token_output import op7_token_output
from .topk_search import OP2_SQL, op2_topk_search

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_topk_search": op2_topk_search,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_sharding": op6_sharding,
    "op7_token_output": op7_token_output,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_html_extraction": op10_html_extraction,
    "op11_quality_rules": op11_quality_rules,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op2_topk_search": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op8_chat_format": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
