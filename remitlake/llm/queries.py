"""The operators' registered queries over the given tables, and their results in DuckDB's SQL where it can state them."""

from __future__ import annotations

from .alignment import op11
from .byte_bpe import op2
from .conversations import op12
from .minhash import op7
from .mtree import OP1_SQL, op1
from .packing import op9
from .pii import op3
from .quality import op5
from .simhash import op13
from .substring_dedup import op10
from .suffix_dedup import op8
from .token_store import op4
from .url_filter import op6, op6_sql

QUERIES = {
    "op1_mtree_topk": op1,
    "op2_byte_bpe": op2,
    "op3_pii": op3,
    "op4_token_store": op4,
    "op5_quality_rules": op5,
    "op6_url_filter": op6,
    "op7_minhash": op7,
    "op8_suffix_array": op8,
    "op9_packing": op9,
    "op10_substring_dedup": op10,
    "op11_cross_tokenizer": op11,
    "op12_conversations": op12,
    "op13_simhash": op13,
}

ORACLES = {"op1_mtree_topk": OP1_SQL, "op6_url_filter": op6_sql()}
