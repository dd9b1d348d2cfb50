"""The operators' registered queries and their SQL."""

from __future__ import annotations

from foliant.llm.bpe import op2_byte_bpe
from foliant.llm.chat import OP8_SQL, op8_preference_format
from foliant.llm.katz import op6_katz_backoff
from foliant.llm.linededup import OP1_SQL, op1_line_winnowing
from foliant.llm.neighbours import OP9_SQL, op9_nn_descent
from foliant.llm.packing import op7_mixture_packing
from foliant.llm.quality import op5_bradley_terry
from foliant.llm.simhash import op10_simhash_golay
from foliant.llm.topk import OP4_SQL, op4_kdtree_topk
from foliant.llm.warc import op3_warc_index

QUERIES = {
    "op1_line_winnowing": op1_line_winnowing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc_index": op3_warc_index,
    "op4_kdtree_topk": op4_kdtree_topk,
    "op5_bradley_terry": op5_bradley_terry,
    "op6_katz_backoff": op6_katz_backoff,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_preference_format": op8_preference_format,
    "op9_nn_descent": op9_nn_descent,
    "op10_simhash_golay": op10_simhash_golay,
}

SQL = {"op1_line_winnowing": OP1_SQL, "op4_kdtree_topk": OP4_SQL, "op8_preference_format": OP8_SQL, "op9_nn_descent": OP9_SQL}
