"""Queries of the text operators and the SQL they are held against."""

from __future__ import annotations

from ledgerline.llm.filter_audit import OP12_SQL, op12_filter_audit
from ledgerline.llm.fingerprints import op10_fingerprints
from ledgerline.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from ledgerline.llm.kd_shards import op4_kd_shards
from ledgerline.llm.line_dedup import OP1_SQL, op1_line_dedup
from ledgerline.llm.merkle import OP13_SQL, op13_merkle
from ledgerline.llm.mixing import op2_mixing
from ledgerline.llm.packing import op9_packing
from ledgerline.llm.pii import op6_pii
from ledgerline.llm.quality_rules import OP5_SQL, op5_quality_rules
from ledgerline.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from ledgerline.llm.toxicity import op8_toxicity
from ledgerline.llm.vp_trees import op11_vp_trees

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_kd_shards": op4_kd_shards,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_vp_trees": op11_vp_trees,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
