"""The operators' queries, each over its whole tables."""

from __future__ import annotations

import corpus_pipeline
from paginarium.llm import automaton, brown, counterfactual, dawg, minhash, packing, qda, rans, shuffle, toivonen, topk, tsearch, webp

QUERIES = {
    "op1_rans_tokens": rans.op1,
    "op2_brown_lm": brown.op2,
    "op3_qda_quality": qda.op3,
    "op4_divideskip_join": tsearch.op4,
    "op5_counterfactual_toxicity": counterfactual.op5,
    "op6_bpe_automaton": automaton.op6,
    "op7_cutting_stock": packing.op7,
    "op8_two_pass_shuffle": shuffle.op8,
    "op9_threshold_topk": topk.op9,
    "op10_webp_lossless": webp.op10,
    "op11_minhash_bayes": minhash.op11,
    "op12_conversation_dawg": dawg.op12,
    "op13_toivonen_phrases": toivonen.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op9_threshold_topk": topk.ORACLE,
    "op11_minhash_bayes": minhash.op11,
    "op12_conversation_dawg": dawg.ORACLE,
    "op13_toivonen_phrases": toivonen.ORACLE,
}
