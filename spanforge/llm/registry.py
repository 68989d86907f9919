"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from spanforge.llm.chat import OP9_SQL, op9_preference
from spanforge.llm.fingerprints import op2_minhash
from spanforge.llm.neighbours import op7_cross_polytope
from spanforge.llm.packing import op6_packing
from spanforge.llm.pages import op8_main_text
from spanforge.llm.sharding import op4_virtual_slots
from spanforge.llm.simhash import op1_simhash
from spanforge.llm.suffixes import OP3_SQL, op3_suffix
from spanforge.llm.tokens import op5_byte_bpe
from spanforge.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_minhash": op2_minhash,
    "op3_suffix": op3_suffix,
    "op4_virtual_slots": op4_virtual_slots,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_main_text": op8_main_text,
    "op9_preference": op9_preference,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {"op3_suffix": OP3_SQL, "op9_preference": OP9_SQL}
