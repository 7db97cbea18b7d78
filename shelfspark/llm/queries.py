"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bitsliced, bpe, classifier, dartminhash, licenses, line_dedup, packing, quality_rules, records, sharding

QUERIES = {
    "op1_fuzzy_lines": line_dedup.op1_fuzzy_lines,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_records": records.op3_records,
    "op4_near_duplicates": dartminhash.op4_near_duplicates,
    "op5_line_frequency": quality_rules.op5_line_frequency,
    "op6_quality": classifier.op6_quality,
    "op7_licences": licenses.op7_licences,
    "op8_top_k": bitsliced.op8_top_k,
    "op9_best_fit": packing.op9_best_fit,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES: dict[str, str] = {
    "op5_line_frequency": quality_rules.ORACLE,
    "op7_licences": licenses.ORACLE,
    "op8_top_k": bitsliced.ORACLE,
}
