"""Queries of this subpackage, and their SQL where SQL can express them."""
from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_quality_rules": op1.op1_quality_rules,
    "op2_mix_sources": op2.op2_mix_sources,
    "op3_kneser_ney": op3.op3_kneser_ney,
    "op4_pack_windows": op4.op4_pack_windows,
    "op5_language_id": op5.op5_language_id,
    "op6_multiset_fingerprints": op6.op6_multiset_fingerprints,
    "op7_toxicity": op7.op7_toxicity,
    "op8_reply_trees": op8.op8_reply_trees,
    "op9_ngram_jaccard": op9.op9_ngram_jaccard,
    "op10_personal_data": op10.op10_personal_data,
    "op11_merkle_manifest": op11.op11_merkle_manifest,
    "op12_lm_scores": op12.op12_lm_scores,
    "op13_phrase_collocations": op13.op13_phrase_collocations,
}
ORACLES = {"op2_mix_sources": op2.SQL, "op8_reply_trees": op8.SQL, "op9_ngram_jaccard": op9.SQL, "op11_merkle_manifest": op11.SQL, "op13_phrase_collocations": op13.SQL}
