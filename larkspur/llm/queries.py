"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from larkspur.llm.bpe import op7_bpe
from larkspur.llm.chat import OP9_SQL, op9_chat
from larkspur.llm.decontaminate import OP2_SQL, op2_decontaminate
from larkspur.llm.hmm import op3_hmm
from larkspur.llm.linedup import op6_lines
from larkspur.llm.mincut import op1_extract
from larkspur.llm.ngramjoin import OP4_SQL, op4_ngram_jaccard
from larkspur.llm.quality import op10_quality
from larkspur.llm.substring import OP5_SQL, op5_substrings
from larkspur.llm.topk import OP8_SQL, op8_topk

QUERIES = {
    "op1_extract": op1_extract,
    "op2_decontaminate": op2_decontaminate,
    "op3_hmm": op3_hmm,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_substrings": op5_substrings,
    "op6_lines": op6_lines,
    "op7_bpe": op7_bpe,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_substrings": OP5_SQL, "op8_topk": OP8_SQL, "op9_chat": OP9_SQL}
