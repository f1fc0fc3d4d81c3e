"""Queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from .automaton import op8_substring_dedup
from .bpe import op1_byte_bpe
from .decontam import op2_decontamination
from .egojoin import op7_embedding_near_dedup
from .langid import op9_language_id
from .lines import OP5_SQL, op5_line_dedup
from .oracles import OP4_SQL, OP7_SQL, OP8_SQL
from .pii import op6_pii_spans
from .sharding import op10_sharding
from .simhash import op3_simhash_components
from .suffixarray import op4_suffix_array_dedup

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_components": op3_simhash_components,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii_spans": op6_pii_spans,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {
    "op4_suffix_array_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
}
