"""Queries of the training-data operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from relq.llm.chatmask import OP3_SQL, op3_chat
from relq.llm.decontam import OP9_SQL, op9_decontamination
from relq.llm.hardneg import OP13_SQL, op13_hard_negatives
from relq.llm.langid import op8_language
from relq.llm.minhash import op4_fingerprints
from relq.llm.packing import op6_packing
from relq.llm.quality import op2_quality
from relq.llm.sharding import op1_sharding
from relq.llm.simhash import op10_simhash
from relq.llm.substrings import OP11_SQL, op11_substrings
from relq.llm.suffixtree import op7_suffix_tree
from relq.llm.toxicity import op5_toxicity
from relq.llm.whitening import op12_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_substrings": op11_substrings,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_substrings": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
